"""Decisions on findings: evidence, confidence, routes, calibration, and the metrics of feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUTES = ("auto_fix", "ai_review", "manual_review")
AUTO, MANUAL, BASE, MOST_SHIFT = 0.8, 0.3, 0.5, 0.05

#: (code, field, value, delta, evidence source, risk that it raises to) of the evidence that doesn't depend on feedback.
EVIDENCE = [
    ("simple_fix_bonus", "simple", "true", 0.3, "base_rule", "low"),
    ("missing_suggestion_penalty", "suggestion", "", -0.4, "suggestion_quality", "high"),
    ("grammar_signal", "category", "grammar", 0.2, "category_signal", "low"),
    ("style_signal", "category", "style", 0.1, "category_signal", "low"),
    ("meaning_loss_medium_penalty", "semantic", "medium", -0.15, "semantic_evidence", "medium"),
    ("meaning_loss_high_penalty", "semantic", "high", -0.3, "semantic_evidence", "high"),
    ("placeholder_mismatch_penalty", "placeholder", "mismatch", -0.1, "placeholder_integrity", "medium"),
    ("placeholder_missing_penalty", "placeholder", "missing", -0.2, "placeholder_integrity", "high"),
    ("glossary_alignment_bonus", "glossary", "approved", 0.05, "glossary_signal", "low"),
    ("glossary_drift_penalty", "glossary", "drift", -0.1, "glossary_signal", "medium"),
    ("glossary_violation_penalty", "glossary", "violation", -0.15, "glossary_signal", "medium"),
    ("structural_consistency_bonus", "structure", "ok", 0.05, "structural_consistency", "low"),
    ("structural_shape_mismatch_penalty", "structure", "shape_mismatch", -0.1, "structural_consistency", "medium"),
    ("structural_collision_penalty", "structure", "nested_collision", -0.15, "structural_consistency", "medium"),
]


def contributions() -> Column:
    """Array of (code, delta, source, risk) for the columns simple, suggestion, category, semantic, placeholder, glossary, structure."""
    one = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == v, F.struct(F.lit(c).alias("code"), F.lit(d).alias("delta"), F.lit(s).alias("source"), F.lit(("low", "medium", "high").index(r)).alias("risk"))) for c, f, v, d, s, r in EVIDENCE]
    return F.filter(F.array(*one), lambda x: x.isNotNull())


def confidence(found: Column) -> Column:
    """Base plus the deltas in order, within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(found, F.lit(BASE), lambda a, x: a + x["delta"])))


def risk(found: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.coalesce(F.array_max(F.transform(found, lambda x: x["risk"])), F.lit(0)) + 1)


def route(conf: Column, simple: Column, auto: Column | float = AUTO) -> Column:
    auto = auto if isinstance(auto, Column) else F.lit(auto)
    return F.when((conf >= auto) & simple, "auto_fix").when(conf <= MANUAL, "manual_review").otherwise("ai_review")


def family() -> Column:
    """The issue's family, the weightiest evidence first."""
    c = F.col
    return F.when(c("semantic").isin("medium", "high"), "meaning_loss").when(c("placeholder").isin("mismatch", "missing"), "placeholder").when(c("glossary").isin("approved", "drift", "violation"), "glossary").when(c("structure").isin("ok", "shape_mismatch", "nested_collision"), "structural").when(c("category") == "grammar", "grammar").when(c("category") == "style", "style").otherwise("generic")


def decide(found: DataFrame) -> DataFrame:
    """found with contributions, confidence (6 digits), risk, family and route."""
    d = found.withColumn("contributions", contributions())
    d = d.withColumn("confidence", F.round(confidence(F.col("contributions")), 6)).withColumn("risk", risk(F.col("contributions"))).withColumn("family", family())
    return d.withColumn("route", route(F.col("confidence"), F.col("simple")))


def contribution_summary(decided: DataFrame) -> DataFrame:
    """(id, source, total, codes): deltas by source of evidence."""
    x = decided.select("id", F.posexplode("contributions").alias("p", "x")).select("id", "p", "x.*")
    g = x.groupBy("id", "source").agg(F.round(F.sum("delta"), 6).alias("total"), F.array_sort(F.collect_list(F.struct("p", "code"))).alias("c"))
    return g.select("id", "source", "total", F.array_join(F.transform("c", lambda y: y["code"]), ",").alias("codes"))


def feedback_metrics(signals: DataFrame) -> DataFrame:
    """(route, total, acceptance_rate, rejection_rate, avg_confidence); no route counts as unknown."""
    r = F.coalesce(F.nullif("route", F.lit("")), F.lit("unknown"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return signals.groupBy(r.alias("route")).agg(F.count("*").alias("total"), rate("accepted").alias("acceptance_rate"), rate("rejected").alias("rejection_rate"), rate("confidence").alias("avg_confidence"))


def rejection_by_risk(signals: DataFrame) -> DataFrame:
    r = F.coalesce(F.nullif("risk", F.lit("")), F.lit("unknown"))
    return signals.groupBy(r.alias("risk")).agg(F.count("*").alias("total"), F.count_if("rejected").alias("rejected"), F.round(F.avg(F.col("rejected").cast("double")), 4).alias("rejection_rate"))


def calibration(metrics: DataFrame, target: float = 0.1, most: float = MOST_SHIFT) -> DataFrame:
    """(route, threshold, adjustment): the automatic threshold rises by the rejections beyond the target, by at most ``most``."""
    shift = F.least(F.lit(most), F.greatest(F.lit(0.0), F.col("rejection_rate") - target))
    return metrics.where("route = 'auto_fix'").select("route", F.round(F.lit(AUTO) + shift, 6).alias("threshold"), F.round(shift, 6).alias("adjustment"))


def calibrate(decided: DataFrame, metrics: DataFrame) -> DataFrame:
    """decided with route after calibration: automatic fixes below the raised threshold go to AI review."""
    t = calibration(metrics).select("threshold")
    d = decided.join(F.broadcast(t), how="left")  # at most one row
    return d.withColumn("route", F.when((F.col("route") == "auto_fix") & (F.col("confidence") < F.coalesce("threshold", F.lit(AUTO))), "ai_review").otherwise(F.col("route"))).drop("threshold")


def context_rules(decided: DataFrame, style_strictness: float = 0.5, tolerance: str = "low", prefer_manual: bool = False) -> DataFrame:
    """Style findings lose .3 of the strictness; with low tolerance risky automatic fixes go to review; manual work can be preferred. In this order, after the route."""
    c = F.when(F.col("category") == "style", F.greatest(F.lit(0.0), F.col("confidence") - 0.3 * style_strictness)).otherwise(F.col("confidence"))
    r = F.when((F.lit(tolerance) == "low") & (F.col("route") == "auto_fix") & (F.col("risk") != "low"), "ai_review").otherwise(F.col("route"))
    r = F.when(F.lit(prefer_manual) & (r == "ai_review"), "manual_review").otherwise(r)
    return decided.withColumn("confidence", F.round(c, 6)).withColumn("route", r)


def routing_metrics(decided: DataFrame) -> DataFrame:
    """One row: counts by route and risk, and the mean confidence (4 digits)."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return decided.agg(*[n("route", r).alias(r) for r in ROUTES], *[n("risk", r).alias(f"risk_{r}") for r in ("low", "medium", "high")], F.round(F.sum("confidence") / F.greatest(F.lit(1), F.count("*")), 4).alias("average_confidence"))


def decision_quality(decided: DataFrame) -> DataFrame:
    """(route, band, n): routes by confidence band; all combinations, also empty ones."""
    spark = decided.sparkSession
    grid = spark.createDataFrame([(r, b) for r in ROUTES for b in ("low", "mid", "high")], "route string, band string")
    band = F.when(F.col("confidence") < 0.4, "low").when(F.col("confidence") < 0.75, "mid").otherwise("high")
    n = decided.groupBy("route", band.alias("band")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(n, ["route", "band"], "left").select("route", "band", F.coalesce("n", F.lit(0)).alias("n"))


def learning_profile(runs: DataFrame) -> DataFrame:
    """(project, runs, acceptance, rejection, first, last): rates of each run averaged over runs (project, run, ts, total, accepted, rejected)."""
    rate = lambda c: F.round(F.avg(F.col(c) / F.greatest(F.lit(1), F.col("total"))), 4)
    return runs.groupBy("project").agg(F.count("*").alias("runs"), rate("accepted").alias("acceptance"), rate("rejected").alias("rejection"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def adaptation_signals(profile: DataFrame, least_runs: int = 5) -> DataFrame:
    """(project, signal, id): which thresholds a profile passes; the id is a hash of both."""
    tests = F.array(F.when(F.col("acceptance") < 0.35, "low_acceptance"), F.when(F.col("acceptance") >= 0.35, "steady_acceptance"), F.when(F.col("rejection") > 0.15, "high_rejection"))
    d = profile.where(F.col("runs") >= least_runs).select("project", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("signal"))
    return d.withColumn("id", F.substring(F.sha2(F.concat_ws(":", "project", "signal"), 256), 1, 12))


def govern(signals: DataFrame) -> DataFrame:
    """(project, signal, verdict): only signals on known targets pass."""
    v = F.when(F.col("project") == "unknown", "rejected_unknown_target").when(F.col("signal") == "steady_acceptance", "rejected_no_action").otherwise("accepted")
    return signals.select("project", "signal", v.alias("verdict"))
