"""Findings: normalization, deduplication, merging, order and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.schema import issue_code, normalize_severity, severity_of, severity_rank


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def normalize(found: DataFrame) -> DataFrame:
    """Severity by the source's table where none is given, issue code, old and new never null."""
    own = F.nullif(F.lower(F.trim("severity")), F.lit(""))
    severity = F.coalesce(normalize_severity(own), F.lit("info"))
    return found.withColumn("severity", F.when(own.isNull(), severity_of(F.col("source"), F.col("issue_type"))).otherwise(severity)).withColumn("code", issue_code(F.col("issue_type"))).withColumn("old", F.coalesce("old", F.lit(""))).withColumn("new", F.coalesce("new", F.lit("")))


def first_of(found: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each combination of keys; the others are dropped on the map side already."""
    rest = [c for c in found.columns if c not in keys]
    one = found.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x"))
    return one.select(*keys, "_x.*").select(*found.columns)


def dedupe(found: DataFrame) -> DataFrame:
    return first_of(found, ["source", "key", "issue_type", "old", "message"])


def sort(found: DataFrame) -> DataFrame:
    return found.orderBy(severity_rank(F.col("severity")), "source", "key", "issue_type", "seq")


def summary(found: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by severity, source, issue type and in all, in one pass over grouping sets."""
    d = found.select("severity", "source", "issue_type")
    g = d.groupingSets([[F.col("severity")], [F.col("source")], [F.col("issue_type")], []], F.col("severity"), F.col("source"), F.col("issue_type")).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "source").when(F.col("g") == 6, "issue_type").otherwise("total")
    return g.select(name.alias("dimension"), F.coalesce("severity", "source", "issue_type", F.lit("")).alias("value"), "n")


def merge(found: DataFrame) -> DataFrame:
    """One row for each (key, locale): the finding of most weight, all distinct messages in order, the number of findings."""
    weight = F.when(F.col("issue_type") == "empty_string", 0).when(F.col("issue_type") == "missing_in_ar", 1).when(F.col("issue_type") == "empty_ar", 2).when(F.col("issue_type") == "missing_ar", 3).otherwise(9)
    g = found.groupBy("key", "locale").agg(F.min_by("issue_type", F.struct(weight, "seq")).alias("issue_type"), F.array_sort(F.collect_list(F.struct("seq", "message"))).alias("m"), F.count("*").alias("n"))
    return g.select("key", "locale", "issue_type", F.array_join(F.array_distinct(F.transform("m", lambda x: x["message"])), " | ").alias("messages"), "n")


def priority_order(found: DataFrame) -> DataFrame:
    """(source, n): critical and high findings by source, most first; ties by the source's first finding."""
    return found.where(F.col("severity").isin("critical", "high")).groupBy("source").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").select("source", "n")


def source_status(found: DataFrame, sources: list[str]) -> DataFrame:
    """(source, n, status) for each source asked for."""
    want = found.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    n = found.groupBy("source").agg(F.count("*").alias("n"))
    return F.broadcast(want).join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) == 0, "passed").otherwise("issues").alias("status"))


def classification(source: Column, issue_type: Column, old: Column, new: Column, verified: Column | None = None) -> Column:
    """auto_safe or review_required."""
    small = tx.is_small_change(old, new)
    spacing = ["whitespace", "spacing", *(f"{x}_spacing" for x in ("punctuation", "bracket", "slash"))]
    safe = F.when(new == "", False)
    safe = safe.when(source == "locale_qc", issue_type.isin(spacing[:2]) | (issue_type.isin("style", "spelling", "capitalization") & small))
    safe = safe.when(source == "ar_locale_qc", issue_type.isin(spacing) | ((issue_type == "english_punctuation") & small))
    safe = safe.when(source == "ai_review", (F.lit(False) if verified is None else verified) & small)
    return F.when(safe.otherwise(False), "auto_safe").otherwise("review_required")


def fix_plan(found: DataFrame) -> DataFrame:
    """(key, locale, candidate, classification, sources): one row a candidate; keys with several candidates go to review."""
    d = found.where("new <> ''").withColumn("c", classification(F.col("source"), F.col("issue_type"), F.col("old"), F.col("new")))
    g = d.groupBy("key", "locale", "new").agg(F.min_by("c", "seq").alias("c"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    n = F.size(F.collect_set("new").over(Window.partitionBy("key", "locale")))
    return g.select("key", "locale", F.col("new").alias("candidate"), F.when(n > 1, "review_required").otherwise(F.col("c")).alias("classification"), "sources")


def duplicate_values(entries: DataFrame, least: int = 5) -> DataFrame:
    """(norm, keys, n): texts that several keys have, but for case and white space at the ends."""
    norm = F.lower(tx.strip(F.col("value")))
    g = entries.select("key", norm.alias("norm")).where(F.length("norm") >= least).groupBy("norm").agg(F.array_sort(F.collect_set("key")).alias("k"))
    return g.where(F.size("k") > 1).select("norm", F.array_join("k", ",").alias("keys"), F.size("k").cast("bigint").alias("n"))


def duplicate_keys(entries: DataFrame, least: int = 5) -> DataFrame:
    """(key, norm, first, n): each key whose text another key has too, with the least of these keys and their number; rows stay short however many share a text."""
    d = entries.select("key", F.lower(tx.strip(F.col("value"))).alias("norm")).where(F.length("norm") >= least)
    g = d.groupBy("norm").agg(F.min("key").alias("first"), F.count_distinct("key").alias("n")).where("n > 1")
    return d.distinct().join(g, "norm").select("key", "norm", "first", "n")


def case_variants(entries: DataFrame) -> DataFrame:
    """(norm, variants): spellings of one text that differ in case."""
    v = tx.strip(F.col("value"))
    g = entries.select(F.lower(v).alias("norm"), v.alias("v")).groupBy("norm").agg(F.array_sort(F.collect_set("v")).alias("v"))
    return g.where(F.size("v") > 1).select("norm", F.array_join("v", " | ").alias("variants"))


def inconsistent_translations(pairs: DataFrame) -> DataFrame:
    """(norm, text, n, canonical, issue_type): translations of one source text other than the commonest (then least) one."""
    e, a = F.lower(tx.normalize_for_compare(F.col("en"))), tx.normalize_for_compare(F.col("ar"))
    g = pairs.where(~tx.is_blank(F.col("en")) & ~tx.is_blank(F.col("ar"))).groupBy(e.alias("norm"), a.alias("text")).agg(F.countDistinct("key").alias("n"))
    w = Window.partitionBy("norm").orderBy(F.desc("n"), "text")
    r = g.withColumn("k", F.row_number().over(w)).withColumn("canonical", F.first("text").over(w))
    same = tx.without_punctuation(F.col("text")) == tx.without_punctuation(F.col("canonical"))
    return r.where("k > 1").select("norm", "text", "n", "canonical", F.when(same, "similar_phrase_variation").otherwise("inconsistent_translation").alias("issue_type"))


def signals(found: DataFrame, rules: int = 5) -> DataFrame:
    """(key, style, grammar, rules): per key counts, and the first rules ids in order."""
    g = found.groupBy("key").agg(F.count_if(F.col("issue_type") == "style").alias("style"), F.count_if(F.col("issue_type") == "grammar").alias("grammar"), F.array_sort(F.collect_set("message")).alias("r"))
    return g.select("key", "style", "grammar", F.array_join(F.slice("r", 1, rules), ",").alias("rules"))


def resolve_conflicts(changes: DataFrame) -> DataFrame:
    """(key, old, seq): of changes (seq, key, old, priority) of one text, that which remains when they come in order and only a higher priority replaces.

    What remains is the first with the highest priority. For changes with places see ``resolve_spans``.
    """
    return changes.groupBy("key", "old").agg(F.min_by("seq", F.struct(-F.col("priority"), F.col("seq"))).alias("seq"))


def resolve_spans(changes: DataFrame) -> DataFrame:
    """(key, seq): the accepted of changes (seq, key, start, length, priority); an overlap is lost to equal or higher priority, else it replaces all it overlaps. An ordered fold for each key."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "start", "length", "priority")))
    empty = F.array().cast("array<struct<seq:bigint,start:bigint,length:bigint,priority:bigint>>")

    def step(kept: Column, r: Column) -> Column:
        hits = lambda x: F.greatest(x["start"], r["start"]) < F.least(x["start"] + x["length"], r["start"] + r["length"])
        loses = F.exists(kept, lambda x: hits(x) & (r["priority"] <= x["priority"]))
        return F.when(loses, kept).otherwise(F.concat(F.filter(kept, lambda x: ~hits(x)), F.array(r)))

    d = changes.select("seq", "key", *[F.col(c).cast("bigint").alias(c) for c in ("start", "length", "priority")])
    return d.groupBy("key").agg(F.aggregate(rows, empty, step).alias("k")).select("key", F.explode("k.seq").alias("seq"))


def conflicting_approvals(approved: DataFrame) -> DataFrame:
    """(key, locale): approved rows with more than one distinct text."""
    return approved.groupBy("key", "locale").agg(F.countDistinct("new").alias("n")).where("n > 1").select("key", "locale")
