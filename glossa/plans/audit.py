"""A whole audit: catalogs, code and glossary to normalized, deduplicated findings, their summary and the plan of fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import icu
from glossa.functions import placeholders as ph
from glossa.functions import text as tx
from glossa.operators import arabic as ar
from glossa.operators import findings as fi
from glossa.operators import glossary as gl
from glossa.operators import pairs as pr
from glossa.operators import usage as us
from glossa.plans.adapters import GLOSSARY, PAIRS, rows, spread
from glossa.plans.registry import query
from glossa.session import ship
from glossa.sources import catalogs as ca


_FIELDS = ("source", "locale", "issue_type", "severity", "message", "old", "new")
_ARRAY = f"array<struct<{','.join(f'{c}:string' for c in _FIELDS)}>>"


def _finding(source: str, locale: str, kind: Column | str, message: Column | str = "", old: Column | str = "", new: Column | str = "", severity: Column | str = "") -> Column:
    values = dict(zip(_FIELDS, (source, locale, kind, severity, message, old, new)))
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def _rows(d: DataFrame, part: int, *finding) -> DataFrame:
    return d.select(F.lit(part).alias("_part"), "key", _finding(*finding).alias("x")).select("_part", "key", "x.*")


def _of_a_pair(k: Column, e: Column, a: Column, e_marks: Column, a_marks: Column, icu_issues: Column) -> dict[int, Column]:
    """Findings that a pair tells by itself: an array for each part of the audit, by the part's place in the order."""
    one = lambda when, f: F.when(when, F.array(f)).otherwise(F.array().cast(_ARRAY))
    missing = F.when(e.isNull(), "in_ar_not_en").when(a.isNull(), "in_en_not_ar").when(tx.is_blank(e), "empty_en").when(tx.is_blank(a), "empty_ar")
    each = lambda found, f: F.transform(found, f)
    arabic = F.filter(ar.issues(k, a), lambda x: x["issue_type"] != "empty_string")
    return {
        0: tx.let(missing, lambda m: one(m.isNotNull(), _finding("localization", "ar", m))),
        1: each(pr.spacing(e), lambda x: _finding("locale_qc", "en", x["issue_type"], "", e, x["new"])),
        2: each(tx.wording_issues(e), lambda x: _finding("locale_qc", "en", x["issue_type"], x["message"], e, x["new"])),
        3: one(tx.is_title_case(e) & ~tx.is_technical(e), _finding("locale_qc", "en", "capitalization", "", e, tx.sentence_case(e))),
        5: F.when(a.isNotNull(), each(arabic, lambda x: _finding("ar_locale_qc", "ar", x["issue_type"], x["related"], a, x["new"], x["severity"]))),
        6: each(pr.shape_changes(e, a), lambda x: _finding("ar_semantic_qc", "ar", x["issue_type"], x["actions"])),
        7: each(ph.compare(e_marks, a_marks), lambda x: _finding("placeholders", "ar", x["issue_type"], x["message"], e, "", x["severity"])),
        8: F.when((e.contains("{") | a.contains("{")) & ~tx.is_blank(e) & ~tx.is_blank(a), each(icu_issues, lambda x: _finding("icu_message_audit", "ar", x, "", a))),
        9: one(pr.is_identical(e, a), _finding("basic_consistency", "ar", "identical_translation", "", e)),
    }


def _numbered(part: int, found: Column) -> Column:
    return F.transform(F.coalesce(found.cast(_ARRAY), F.array().cast(_ARRAY)), lambda x: F.struct(F.lit(part).alias("_part"), *[x[f].alias(f) for f in _FIELDS]))


def findings(pairs: DataFrame, glossary: DataFrame | None = None, used: DataFrame | None = None) -> DataFrame:
    """Findings of all audits over pairs (key, en, ar), null where a side lacks the key; glossary (ord, term_en, approved, forbidden), used (key, mode).

    What a pair tells by itself is found in one pass over the pairs, spread over all cores; the other parts are joins.
    """
    e, a = F.col("en"), F.col("ar")
    pairs = spread(pairs.select("key", "en", "ar"))
    parsed = pairs.select("key", "en", "ar", ph.parse(e).alias("_e"), ph.parse(a).alias("_a"), icu.issues(e, a).alias("_icu"))
    found = _of_a_pair(F.col("key"), e, a, F.col("_e"), F.col("_a"), F.col("_icu"))
    parts = [
        parsed.select("key", F.explode(F.flatten(F.array(*[_numbered(*p) for p in found.items()]))).alias("x")).select("key", "x.*"),
        _rows(fi.duplicate_keys(pairs.where(e.isNotNull()).select("key", e.alias("value"))), 4, "locale_qc", "en", "duplicate_value", F.concat(F.lit("with "), F.col("first"), F.lit(", "), F.col("n").cast("string"), F.lit(" in all")), F.col("norm")),
    ]
    if glossary is not None:
        there = pairs.where(~tx.is_blank(e) & ~tx.is_blank(a))
        parts.append(_rows(gl.compliance(there, glossary), 10, "terminology", "ar", F.col("issue_type"), F.col("term_en"), a, F.col("approved")))
    if used is not None:
        status = us.key_status(pairs.where(e.isNotNull()), pairs.where(a.isNotNull()), used).where("status not in ('used', 'dynamic')")
        parts.append(_rows(status, 10 + (glossary is not None), "localization", "ar", F.when(F.col("status") == "unused", "confirmed_unused_key").otherwise(F.col("status"))))
    return _first(fi.union(parts))


def _first(found: DataFrame) -> DataFrame:
    """``findings.dedupe`` of the normalized findings by seq: by audit, then by key, then by what the row says, so it is the same in each run. Each text is shuffled once; what the group has alike isn't compared."""
    has_old, old = F.col("old").isNotNull(), F.coalesce("old", F.lit(""))
    g = found.groupBy("key", "source", "issue_type", old.alias("old"), "message").agg(F.min(F.struct("_part", has_old.alias("o"), "new", "locale", "severity")).alias("x"))
    seq = F.struct("x._part", "key", "issue_type", "message", F.when(F.col("x.o"), F.col("old")).alias("old"), "x.new")
    return fi.normalize(g.select("source", "key", "x.locale", "issue_type", "x.severity", "message", "old", "x.new", seq.alias("seq")))


def run_audit(spark: SparkSession, en_path: str, ar_path: str, fmt: str = "json", code_path: str | None = None, suffixes: tuple[str, ...] = (".vue", ".tsx", ".php", ".jsx", ".dart", ".ts", ".js"), glossary_path: str | None = None) -> dict[str, DataFrame]:
    """findings, summary and plan of a project's files."""
    ship(spark)
    text = lambda d, n: d.where("value_type = 'string'").select("key", F.col("value").alias(n))
    pairs = text(ca.read_catalog(spark, en_path, "en", fmt), "en").join(text(ca.read_catalog(spark, ar_path, "ar", fmt), "ar"), "key", "full")
    used = us.normalize_keys(us.scan(ca.read_code(spark, code_path, suffixes), patterns=us.BUILTIN), pairs) if code_path else None
    found = findings(pairs, ca.read_glossary(spark, glossary_path)[0] if glossary_path else None, used)
    return {"findings": found, "summary": fi.summary(found), "plan": fi.fix_plan(found)}


@query()
def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(rows(spark, sf_dir, PAIRS), rows(spark, sf_dir, GLOSSARY))
