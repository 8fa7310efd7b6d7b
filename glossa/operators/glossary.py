"""Glossary checks: theta joins of texts with terms.

A word-boundary join is turned into an equi join on the term's first word where texts are many; the regular expression then decides. So the
join is a hash join of exploded words, whatever the size of the glossary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tokens(texts: DataFrame, col: str) -> DataFrame:
    """(key, _w): the words of each text; narrow, so that a long text isn't copied to each of its words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(col)), F.lit(r"(?U)\w+"), 0))
    return texts.select("key", F.explode(words).alias("_w"))


def _quoted(c: Column) -> Column:
    """A whole word of a regular expression that stands for itself."""
    return F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))


def term_matches(texts: DataFrame, glossary: DataFrame, col: str = "en") -> DataFrame:
    """(text columns, glossary columns): terms that stand in the text as whole words, whatever their case."""
    terms = glossary.withColumn("_first", F.lower(F.regexp_extract("term_en", r"(?U)(\w+)", 1)))
    words = _tokens(texts, col).join(terms.select(F.col("_first").alias("_w")).distinct(), "_w", "left_semi")  # only words that begin a term are shuffled
    found = words.distinct().join(terms, F.col("_w") == F.col("_first")).drop("_w", "_first")
    return texts.join(found, "key").where(F.regexp_like(F.lower(F.col(col)), _quoted(F.lower("term_en"))))


def compliance(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(key, term_en, issue_type): hard_violation where the approved term lacks, forbidden_term where a forbidden one stands; the latter first."""
    m = term_matches(texts, glossary)
    kind = F.when(F.contains(F.lower("ar"), F.lower("forbidden")), "forbidden_term").when(~F.contains(F.lower("ar"), F.lower("approved")), "hard_violation")
    return m.withColumn("issue_type", kind).where("issue_type is not null")


def forbidden(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(key, forbidden, approved): the first forbidden term, in the glossary's order, that stands in the text."""
    hit = texts.join(glossary, F.contains(F.lower("ar"), F.lower("forbidden")))  # a substring has no key: nested loops, over the glossary as the side that Spark broadcasts if it is small enough
    return hit.groupBy("key").agg(F.min_by(F.struct("forbidden", "approved"), "ord").alias("x")).select("key", "x.forbidden", "x.approved")


def replace_terms(texts: DataFrame, glossary: DataFrame, col: str = "ar") -> DataFrame:
    """(key, text): forbidden terms replaced by approved ones as whole words, the longest first."""
    hit = _tokens(texts, col).join(glossary, F.col("_w") == F.lower(F.regexp_extract("forbidden", r"(?U)(\w+)", 1)))
    by_key = hit.groupBy("key").agg(F.reverse(F.array_sort(F.collect_set(F.struct(F.length("forbidden").alias("n"), "forbidden", "approved")))).alias("_r"))
    d = texts.join(by_key, "key", "left")
    out = F.aggregate(F.coalesce("_r", F.array().cast("array<struct<n:int,forbidden:string,approved:string>>")), F.col(col), lambda acc, x: F.regexp_replace(acc, _quoted(x["forbidden"]), F.replace(F.replace(x["approved"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))))
    return d.select("key", out.alias("text"))
