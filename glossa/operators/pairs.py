"""Joins of catalogs, and the findings that come of a pair of texts.

All are equi joins on the key; Spark broadcasts a side only below its own size threshold. Rows without a key join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.functions.mask import tokens
from glossa.operators.arabic import is_risky

#: English verbs and the Arabic forms that stand for them.
ACTIONS = {"add": "أضف إضافة", "save": "احفظ حفظ", "send": "أرسل إرسال", "delete": "احذف حذف", "approve": "وافق موافقة", "select": "اختر اختيار", "enter": "أدخل إدخال"}


def full_pair(en: DataFrame, ar: DataFrame) -> DataFrame:
    """(key, en, ar) over the union of keys; a side that is missing is ''."""
    l, r = en.select("key", F.col("value").alias("en")), ar.select("key", F.col("value").alias("ar"))
    return l.join(r, "key", "full").select("key", F.coalesce("en", F.lit("")).alias("en"), F.coalesce("ar", F.lit("")).alias("ar"))


def driven_pair(first: DataFrame, second: DataFrame, names: tuple[str, str] = ("en", "ar")) -> DataFrame:
    """The keys of first with the other side's text, '' where there is none."""
    a, b = names
    l, r = first.select("key", F.col("value").alias(a)), second.select("key", F.col("value").alias(b))
    return l.join(r, "key", "left").select("key", a, F.coalesce(b, F.lit("")).alias(b))


def both_present(en: DataFrame, ar: DataFrame) -> DataFrame:
    """Keys with a text that isn't blank on either side."""
    l, r = en.select("key", F.col("value").alias("en")).where(~tx.is_blank(F.col("en"))), ar.select("key", F.col("value").alias("ar")).where(~tx.is_blank(F.col("ar")))
    return l.join(r, "key")


def missing(have: DataFrame, other: DataFrame) -> DataFrame:
    return have.select("key").distinct().join(other.select("key"), "key", "left_anti")


def identical(pairs: DataFrame) -> DataFrame:
    """Pairs whose texts are equal, not blank and have a letter."""
    return pairs.where(is_identical(F.col("en"), F.col("ar")))


def is_identical(en: Column, ar: Column) -> Column:
    return (en == ar) & ~tx.is_blank(en) & en.rlike(r"\p{L}")


def missing_actions(en: Column, ar: Column) -> Column:
    """Verbs of the English text of which the Arabic has no form, in alphabetical order."""
    any_of = rf"(?U)(?<!\w)(?:{'|'.join(ACTIONS)})(?!\w)"  # one pattern for the many texts without a verb

    def of(e: Column) -> Column:
        def lacking(plain: Column) -> Column:
            lacks = lambda forms: ~F.exists(F.array(*[tx.normalize_arabic(F.lit(f)) for f in forms.split()]), lambda f: plain.contains(f))
            return F.filter(F.array(*[F.when(e.rlike(rf"(?U)(?<!\w){v}(?!\w)") & lacks(ACTIONS[v]), F.lit(v)) for v in sorted(ACTIONS)]), lambda x: x.isNotNull())

        return F.when(e.rlike(any_of), tx.let(tx.normalize_arabic(ar), lacking)).otherwise(F.array().cast("array<string>"))

    return tx.let(F.lower(en), of)


def cues(c: Column) -> Column:
    """Shape, numbers and brace placeholders of a text, as a set."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), 0), lambda x: F.concat(F.lit("n:"), x))
    marks = F.transform(F.regexp_extract_all(c, F.lit(r"\{[^{}]+\}"), 0), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("s:"), tx.shape(c))), numbers, marks))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def spacing_findings(pairs: DataFrame) -> DataFrame:
    """(key, issue_type, old, new) for padded English texts and runs of blanks."""
    e = F.col("en")
    return pairs.select("key", e.alias("old"), F.explode(spacing(e)).alias("x")).select("key", "x.issue_type", "old", "x.new")


def spacing(e: Column) -> Column:
    """Array of (issue_type, new) of an English text."""
    found = F.array(
        F.when(tx.strip(e) != e, F.struct(F.lit("whitespace").alias("issue_type"), tx.strip(e).alias("new"))),
        F.when(e.contains("  ") & ~is_risky(e, tokens(e)), F.struct(F.lit("spacing").alias("issue_type"), tx.collapse(e).alias("new"))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def shape_findings(pairs: DataFrame) -> DataFrame:
    """(key, issue_type, actions): a sentence that became a label, a label that became a sentence, and verbs that were lost."""
    return pairs.select("key", F.explode(shape_changes(F.col("en"), F.col("ar"))).alias("x")).select("key", "x.actions", "x.issue_type")


def shape_changes(e: Column, a: Column) -> Column:
    """Array of (issue_type, actions) of a pair; none where a side is blank."""

    def of(x: Column) -> Column:
        found = F.array(
            F.when((x["e"] == "sentence_like") & x["a"].isin("short_label", "phrase"), "sentence_shape_mismatch"),
            F.when((x["e"] == "short_label") & (x["a"] == "sentence_like"), "message_label_mismatch"),
            F.when((F.size(x["lost"]) > 0) & (F.size(tx.words(e)) >= 3), "possible_meaning_loss"),
        )
        found = F.when((x["e"] != "empty") & (x["a"] != "empty"), F.filter(found, lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda k: F.struct(k.alias("issue_type"), F.array_join(x["lost"], " ").alias("actions")))

    return tx.let(F.struct(tx.shape(e).alias("e"), tx.shape(a).alias("a"), missing_actions(e, a).alias("lost")), of)


def gate_codes(source: Column, suggestion: Column) -> Column:
    """Reasons against a suggestion: empty, unchanged numbers, placeholders, tags, length, lost line ends; in this order."""
    extract = lambda c, rx: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(rx), 0)))
    lost = lambda rx: F.size(F.array_except(extract(source, rx), extract(suggestion, rx))) > 0
    codes = F.array(
        F.when(tx.is_blank(suggestion), "empty"),
        F.when(lost(r"\{[^{}]+\}|%[sd]"), "placeholder_loss"),
        F.when(lost("<[^>]+>"), "tag_loss"),
        F.when(extract(source, "[0-9]+") != extract(suggestion, "[0-9]+"), "number_change"),
        F.when(F.length(suggestion) > 3 * F.length(source), "expansion"),
        F.when(tx.line_count(suggestion) < tx.line_count(source), "line_loss"),
    )
    return F.filter(codes, lambda x: x.isNotNull())


def gate_decision(codes: Column) -> Column:
    """reject for losses, suspicious for other reasons, else accept."""
    return F.when(F.arrays_overlap(codes, F.array(*map(F.lit, ("empty", "placeholder_loss", "tag_loss")))), "reject").when(F.size(codes) > 0, "suspicious").otherwise("accept")
