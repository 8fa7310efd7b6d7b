"""Reports: raw tool rows to findings, noise suppression, profiles, snapshots, text lines."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a tool may use for the old and new text and for the kind of issue, in order of preference.
FIELDS = {"old": ("old", "current_value", "en_value", "target"), "new": ("new", "candidate_value", "candidate", "suggestion"), "issue_type": ("issue_type", "violation_type", "rule_id"), "message": ("message", "reason")}
VISIBLE_INFO = ("ai_review", "camel_validation")


def from_tool(raw: DataFrame, source: str, locale: str | None = None) -> DataFrame:
    """Findings (source, key, locale, issue_type, severity, message, old, new) of a tool's rows, by the first field that isn't blank."""
    have = set(raw.columns)

    def pick(name: str) -> Column:
        there = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in FIELDS[name] if c in have]
        return F.coalesce(*there, F.lit("")).alias(name)

    own = F.coalesce(F.col("locale"), F.lit(locale or "")) if "locale" in have else F.lit(locale or "")
    severity = F.col("severity") if "severity" in have else F.lit("")
    return raw.select(F.lit(source).alias("source"), "key", own.alias("locale"), pick("issue_type"), severity.alias("severity"), pick("message"), pick("old"), pick("new"))


def missing_reports(found: DataFrame, expected: list[str]) -> DataFrame:
    """(source): the expected sources that have no finding."""
    want = found.sparkSession.createDataFrame([(s,) for s in expected], "source string")
    return F.broadcast(want).join(found.select("source").distinct(), "source", "left_anti")


def suppress_noise(found: DataFrame, brands: tuple[str, ...] = ("API", "URL", "ID")) -> DataFrame:
    """found without info rows (but of tools whose info is asked for), capitalization of labels, and spelling of brands."""
    words = F.regexp_extract_all("old", F.lit(r"\w+"), 0)
    brand = F.col("issue_type").isin("grammar", "spelling") & F.arrays_overlap(words, F.array(*map(F.lit, brands)))
    label = (F.col("issue_type") == "capitalization") & F.col("key").rlike("_(label|btn|hint)$")
    info = (F.col("severity") == "info") & ~F.col("source").isin(*VISIBLE_INFO)
    return found.where(~F.coalesce(brand | label | info, F.lit(False)))


def detect_profile(evidence: DataFrame, least: int = 35, margin: int = 10) -> DataFrame:
    """(root, profile, score, second): for each root the profile whose evidence (root, profile, points) weighs most; only above least and clear of the second."""
    g = evidence.groupBy("root", "profile").agg(F.sum("points").alias("score"), F.count("*").alias("reasons"))
    w = Window.partitionBy("root").orderBy(F.desc("score"), F.desc("reasons"), "profile")
    r = g.withColumn("k", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0)))
    return r.where((F.col("k") == 1) & (F.col("score") >= least) & (F.col("score") - F.col("second") >= margin)).select("root", "profile", "score", "second")


def snapshot(decided: DataFrame) -> DataFrame:
    """(dimension, value, n): a run's counts by family, route and risk, in one pass."""
    d = decided.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("family", "route", "risk")])).alias("x"))
    return d.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def distinct_notes(c: Column, by: str = " | ") -> Column:
    """Segments of a note, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(c, re.escape(by)), F.trim), lambda x: x != "")), by)


def distinct_mutations(rows: DataFrame) -> DataFrame:
    """(id, seq): of rows (seq, key, locale, approved) with equal key, locale and text, the first."""
    i = F.concat_ws("|", "key", "locale", F.sha2("approved", 256))
    return rows.groupBy(i.alias("id")).agg(F.min("seq").alias("seq"))


def splice(text: Column, offset: Column, length: Column, replacement: Column) -> Column:
    """text with length characters at offset (from 0) replaced."""
    return F.concat(F.substring(text, F.lit(1), offset), replacement, F.substring(text, offset + length + 1, F.length(text)))


def issue_line(c: str = "") -> Column:
    return F.concat(F.lit("- **"), F.col("severity"), F.lit("** `"), F.col("key"), F.lit("` ("), F.col("issue_type"), F.lit("): "), F.col("message"))


def conflict_counts(changes: DataFrame) -> DataFrame:
    """One row: changes in all, texts with more than one change, changes that don't remain."""
    g = changes.groupBy("key", "old").agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("changes"), F.count_if(F.col("n") > 1).alias("contested"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rejected"))


def repair_json(text: str) -> object | None:
    """The outermost JSON of a model's answer, without code fences, with missing closing brackets added; None if there is none."""
    body = re.sub(r"^\s*```\w*|```\s*$", "", text.strip())
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    try:
        return json.JSONDecoder().raw_decode(body)[0]
    except ValueError:
        pass
    stack, quoted, escaped = [], False, False
    for ch in body:
        if quoted:
            escaped, quoted = ch == "\\" and not escaped, quoted if ch != '"' or escaped else False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    try:
        return json.loads(body + '"' * quoted + "".join(reversed(stack)))
    except ValueError:
        return None


def apply_answers(batch: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, source, suggestion) for the answers to keys of the batch; answers to other keys are dropped."""
    return batch.select("key", "source").join(answers.select("key", "suggestion"), "key")
