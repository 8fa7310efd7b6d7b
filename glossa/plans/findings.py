"""Queries on findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa import schema as sc
from glossa.operators import findings as fi
from glossa.plans.adapters import DOCS, FINDINGS, PAIRS, rows
from glossa.plans.registry import query
from glossa.plans.texts import _PUNCT, strip


def _case(value: str, table: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} IN ({', '.join(repr(x) for x in v.split())}) THEN '{k}'" for k, v in table.items()) + f" ELSE {default} END"


_TABLE = "CASE " + " ".join(f"WHEN source = '{s}' THEN " + _case("issue_type", {k: v for k, v in t.items() if v != "*"}, repr(next(k for k, v in t.items() if v == "*"))) for s, t in sc.SEVERITY.items()) + " ELSE 'info' END"
_NORMAL = f"SELECT * REPLACE (CASE WHEN trim(severity) = '' THEN {_TABLE} WHEN lower(severity) = 'warning' THEN 'medium' ELSE lower(severity) END AS severity), {_case('issue_type', sc.CODES, repr('OTHER'))} AS code FROM ({FINDINGS})"
_FIRST = f"SELECT * FROM ({_NORMAL}) QUALIFY row_number() OVER (PARTITION BY source, key, issue_type, old, message ORDER BY seq) = 1"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END"
_SMALL = r"(old <> '' AND new <> '' AND old <> new AND len(regexp_extract_all(old, '\S+')) <= 12 AND len(regexp_extract_all(new, '\S+')) <= 12 AND abs(length(old) - length(new)) <= greatest(10, length(old) // 2))"
_CLASS = f"CASE WHEN new <> '' AND ((source = 'locale_qc' AND (issue_type IN ('whitespace', 'spacing') OR (issue_type IN ('style', 'spelling', 'capitalization') AND {_SMALL}))) OR (source = 'ar_locale_qc' AND issue_type IN ('whitespace', 'spacing'))) THEN 'auto_safe' ELSE 'review_required' END"
SOURCES = ["locale_qc", "ar_locale_qc", "terminology", "placeholders", "grammar"]


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.normalize(rows(spark, sf_dir, FINDINGS))


@query(_FIRST)
def normalized_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.dedupe(_found(spark, sf_dir))


@query(f"SELECT row_number() OVER (ORDER BY {_RANK}, source, key, issue_type, seq) AS place, seq, severity FROM ({_FIRST}) ORDER BY place LIMIT 30")
def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fi.sort(fi.dedupe(_found(spark, sf_dir))).limit(30)  # the report's length
    order = Window.orderBy(sc.severity_rank(F.col("severity")), "source", "key", "issue_type", "seq")
    return top.select(F.row_number().over(order).cast("bigint").alias("place"), "seq", "severity")


@query(f"""SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM ({_NORMAL}) GROUP BY severity UNION ALL SELECT 'source', source, count(*) FROM ({_NORMAL}) GROUP BY source
 UNION ALL SELECT 'issue_type', issue_type, count(*) FROM ({_NORMAL}) GROUP BY issue_type UNION ALL SELECT 'total', '', count(*) FROM ({_NORMAL})""")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.summary(_found(spark, sf_dir))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE code = '{c}') AS {c.lower()}" for c in sc.CODES) + f", count(*) AS total FROM ({_NORMAL})")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).agg(*[F.count_if(F.col("code") == c).alias(c.lower()) for c in sc.CODES], F.count("*").alias("total"))


@query(f"SELECT key, locale, arg_min(issue_type, w * CAST(1000000000 AS BIGINT) + seq) AS issue_type, (SELECT string_agg(message, ' | ' ORDER BY f) FROM (SELECT message, min(seq) AS f FROM ({_NORMAL}) y WHERE y.key = x.key AND y.locale = x.locale GROUP BY message)) AS messages, count(*) AS n FROM (SELECT *, CASE issue_type WHEN 'missing_in_ar' THEN 1 WHEN 'empty_ar' THEN 2 ELSE 9 END AS w FROM ({_NORMAL})) x GROUP BY key, locale")
def merged_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.merge(_found(spark, sf_dir))


@query(f"SELECT source, count(*) AS n FROM ({_NORMAL}) WHERE severity IN ('critical', 'high') GROUP BY source")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.priority_order(_found(spark, sf_dir))


@query(f"SELECT s.source, count(f.seq) AS n, CASE WHEN count(f.seq) = 0 THEN 'passed' ELSE 'issues' END AS status FROM (SELECT unnest({SOURCES}) AS source) s LEFT JOIN ({_NORMAL}) f ON s.source = f.source GROUP BY s.source")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.source_status(_found(spark, sf_dir), SOURCES)


@query(f"""WITH d AS (SELECT *, {_CLASS} AS c FROM ({_NORMAL}) WHERE new <> ''), g AS (SELECT key, locale, new, arg_min(c, seq) AS c, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM d GROUP BY key, locale, new)
 SELECT key, locale, new AS candidate, CASE WHEN count(*) OVER (PARTITION BY key, locale) > 1 THEN 'review_required' ELSE c END AS classification, sources FROM g""")
def fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.fix_plan(_found(spark, sf_dir))


@query(f"SELECT {_CLASS} AS classification, count(*) AS n FROM ({_NORMAL}) GROUP BY 1")
def safe_fix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fi.classification(F.col("source"), F.col("issue_type"), F.col("old"), F.col("new"))
    return _found(spark, sf_dir).groupBy(c.alias("classification")).agg(F.count("*").alias("n"))


@query(f"SELECT norm, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys, count(DISTINCT key) AS n FROM (SELECT key, lower({strip('value')}) AS norm FROM ({DOCS})) WHERE length(norm) >= 5 GROUP BY norm HAVING count(DISTINCT key) > 1")
def duplicate_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.duplicate_values(rows(spark, sf_dir, DOCS))


_VARIED = "SELECT key, CASE WHEN id % 3 = 0 THEN upper(en) ELSE en END AS value FROM (" + PAIRS + ") WHERE en IS NOT NULL"


@query(f"SELECT norm, string_agg(v, ' | ' ORDER BY v) AS variants FROM (SELECT DISTINCT lower({strip('value')}) AS norm, {strip('value')} AS v FROM ({_VARIED})) GROUP BY norm HAVING count(*) > 1")
def case_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.case_variants(rows(spark, sf_dir, _VARIED))


def _cmp(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({strip(c)}, '\s+', ' ', 'g'), ' ([,.;:!?،؛؟)\]])', '\1', 'g'), '([(\[]) ', '\1', 'g')"


@query(f"""WITH g AS (SELECT lower({_cmp('en')}) AS norm, {_cmp('ar')} AS text, count(DISTINCT key) AS n FROM ({PAIRS}) WHERE {strip('en')} <> '' AND {strip('ar')} <> '' GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER w AS k, first_value(text) OVER w AS canonical FROM g WINDOW w AS (PARTITION BY norm ORDER BY n DESC, text))
 SELECT norm, text, n, canonical, CASE WHEN {_PUNCT.format(c='text')} = {_PUNCT.format(c='canonical')} THEN 'similar_phrase_variation' ELSE 'inconsistent_translation' END AS issue_type FROM r WHERE k > 1""")
def inconsistent_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.inconsistent_translations(rows(spark, sf_dir, PAIRS))


@query(f"SELECT key, count(*) FILTER (WHERE issue_type = 'style') AS style, count(*) FILTER (WHERE issue_type = 'grammar') AS grammar, array_to_string(list_sort(list(DISTINCT message))[1:5], ',') AS rules FROM ({_NORMAL}) GROUP BY key")
def linguistic_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.signals(_found(spark, sf_dir))


@query(f"SELECT key, old, arg_min(seq, {_RANK} * CAST(1000000000 AS BIGINT) + seq) AS seq FROM ({_NORMAL}) GROUP BY key, old")
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.resolve_conflicts(_found(spark, sf_dir).withColumn("priority", -sc.severity_rank(F.col("severity"))))


@query(f"""WITH RECURSIVE c AS (SELECT seq, key, length(old) * (seq % 4) AS start, length(message) * 2 AS length, -({_RANK}) AS priority, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM ({_NORMAL})),
 k AS (SELECT key, 1 AS i, [{{'seq': seq, 's': start, 'e': start + length, 'p': priority}}] AS kept FROM c WHERE i = 1
  UNION ALL SELECT k.key, c.i, CASE WHEN len(list_filter(kept, lambda x: greatest(x.s, start) < least(x.e, start + length) AND priority <= x.p)) > 0 THEN kept
   ELSE list_append(list_filter(kept, lambda x: NOT greatest(x.s, start) < least(x.e, start + length)), {{'seq': seq, 's': start, 'e': start + length, 'p': priority}}) END FROM k JOIN c ON k.key = c.key AND c.i = k.i + 1)
 SELECT key, unnest(list_transform(arg_max(kept, i), lambda x: x.seq)) AS seq FROM k GROUP BY key""")
def span_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _found(spark, sf_dir).select("seq", "key", (F.length("old") * (F.col("seq") % 4)).alias("start"), (F.length("message") * 2).alias("length"), (-sc.severity_rank(F.col("severity"))).alias("priority"))
    return fi.resolve_spans(d)


@query(f"SELECT key, locale FROM ({_NORMAL}) WHERE new <> '' GROUP BY key, locale HAVING count(DISTINCT new) > 1")
def conflicting_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.conflicting_approvals(_found(spark, sf_dir).where("new <> ''"))
