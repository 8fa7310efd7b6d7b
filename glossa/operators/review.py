"""Review: key resolution, hydration, queue, gates and the merge of fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_suffixes(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, status, found) for each requested key: direct, suffix (one catalog key ends with '.' + key), ambiguous, missing or empty.

    Catalog keys are exploded to their dotted suffixes, so that the search is one equi join.
    """
    n = F.size(F.split("key", r"\."))
    parts = F.split("key", r"\.")
    tails = F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array().cast("array<string>"))
    keys = catalog.select("key").distinct()
    suffixes = keys.select(F.col("key").alias("full"), F.explode(tails).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("full").alias("one"))
    d = requests.select("key").distinct().join(keys.select("key", F.lit(True).alias("direct")), "key", "left").join(suffixes, "key", "left")
    status = F.when(F.coalesce("key", F.lit("")) == "", "empty").when(F.col("direct"), "direct").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return d.select("key", status.alias("status"), F.when(status == "direct", F.col("key")).when(status == "suffix", F.col("one")).alias("found"))


def hydrate(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings with the current text of their key and locale, and its hash; '' where there is none."""
    cur = entries.select("key", "locale", F.col("value").alias("current"))
    d = found.join(cur, ["key", "locale"], "left").withColumn("current", F.coalesce("current", F.lit("")))
    return d.withColumn("source_hash", F.sha2("current", 256))


def cross_locale_suggestions(found: DataFrame, en: DataFrame) -> DataFrame:
    """(key, suggestion) for keys missing in the target: the source's text."""
    return found.where(F.col("issue_type").isin("missing_in_ar", "missing_ar")).select("key").distinct().join(en.select("key", F.col("value").alias("suggestion")), "key")


def identity(plan_id: Column, key: Column, locale: Column, source_hash: Column) -> Column:
    """The plan id, or key|locale|hash."""
    return F.coalesce(F.nullif(plan_id, F.lit("")), F.concat_ws("|", key, locale, source_hash))


def overlay(queue: DataFrame, state: DataFrame) -> DataFrame:
    """queue (plan_id, hash, …) with the status of state (plan_id, hash, status): stale where the text has changed, pending where there is none."""
    s = state.select("plan_id", F.col("hash").alias("_h"), F.col("status").alias("_s"))
    d = queue.join(s, "plan_id", "left")
    return d.withColumn("status", F.when(F.col("_s").isNull(), "pending").when(F.col("_h") != F.col("hash"), "stale").otherwise(F.col("_s"))).drop("_h", "_s")


def prepare_gate(workbook: DataFrame, queue: DataFrame, locales: tuple[str, ...] = ("ar", "en")) -> DataFrame:
    """(plan_id, reason) for each row of workbook (plan_id, key, locale, status, approved, current): accepted, or the first reason against it, in this order:

    missing_field, unknown_plan_id, key_drift, source_drift, bad_locale, not_approved, no_change.
    A plan_id that the queue has several times is one: its row of the same key if there is one, else that of the least key.
    """
    q = queue.groupBy("plan_id", F.col("key").alias("_k")).agg(F.min("current").alias("_c"))
    same = q.select("plan_id", F.col("_k").alias("key"), F.col("_c").alias("_same"))
    least = q.groupBy("plan_id").agg(F.min(F.struct("_k", "_c")).alias("_x"))
    d = workbook.join(same, ["plan_id", "key"], "left").join(least, "plan_id", "left")
    d = d.withColumn("_k", F.when(F.col("_same").isNotNull(), F.col("key")).otherwise(F.col("_x._k"))).withColumn("_c", F.coalesce("_same", "_x._c"))
    reason = (
        F.when((F.coalesce("plan_id", F.lit("")) == "") | (F.coalesce("key", F.lit("")) == ""), "missing_field")
        .when(F.col("_k").isNull(), "unknown_plan_id")
        .when(F.col("_k") != F.col("key"), "key_drift")
        .when(F.col("_c") != F.col("current"), "source_drift")
        .when(~F.col("locale").isin(*locales), "bad_locale")
        .when(F.coalesce("status", F.lit("")) != "approved", "not_approved")
        .when(F.col("approved") == F.col("current"), "no_change")
        .otherwise("accepted")
    )
    return d.select("plan_id", reason.alias("reason"))


def merge_fixes(base: DataFrame, auto: DataFrame, review: DataFrame) -> DataFrame:
    """(key, value, origin): base with the automatic fixes, then the reviewed ones on top; only keys of base."""
    d = base.join(auto.select("key", F.col("value").alias("_a")), "key", "left").join(review.select("key", F.col("value").alias("_r")), "key", "left")
    origin = F.when(F.col("_r").isNotNull(), "review").when(F.col("_a").isNotNull(), "auto").otherwise("base")
    return d.select("key", F.coalesce("_r", "_a", "value").alias("value"), origin.alias("origin"))


def last_runs(runs: DataFrame, most: int, by: str = "project", order: str = "ts", tie: str = "id") -> DataFrame:
    """The newest runs of each project."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie)))
    return runs.withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def reconcile(applied: DataFrame, allowed: DataFrame) -> DataFrame:
    """(plan_id, state): applied rows whose plan is allowed, and stale ones."""
    ok = allowed.select("plan_id", F.lit(True).alias("_o")).distinct()
    return applied.join(ok, "plan_id", "left").select("plan_id", F.when(F.col("_o"), "allowed").otherwise("stale").alias("state"))
