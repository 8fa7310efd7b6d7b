"""Queries on decisions and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import decision as de
from glossa.plans.adapters import SIGNALS, rows
from glossa.plans.registry import query

_EVIDENCE = """SELECT event_id AS id, event_id % 3 <> 0 AS simple, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'new' END AS suggestion,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'grammar' WHEN 1 THEN 'style' ELSE 'other' END AS category,
  CASE CAST(user_id % 9 AS INT) WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'low' END AS semantic,
  CASE CAST(user_id % 11 AS INT) WHEN 0 THEN 'mismatch' WHEN 1 THEN 'missing' ELSE '' END AS placeholder,
  CASE CAST(user_id % 5 AS INT) WHEN 0 THEN 'approved' WHEN 1 THEN 'drift' WHEN 2 THEN 'violation' ELSE '' END AS glossary,
  CASE CAST(user_id % 7 AS INT) WHEN 0 THEN 'ok' WHEN 1 THEN 'shape_mismatch' WHEN 2 THEN 'nested_collision' ELSE '' END AS structure FROM events"""
_HIT = {c: f"coalesce(CAST({f} AS STRING), '') = '{v}'" for c, f, v, *_ in de.EVIDENCE}
_SUM = " + ".join(["0.5", *[f"CASE WHEN {_HIT[c]} THEN {d} ELSE 0 END" for c, _, _, d, _, _ in de.EVIDENCE]])
_RISK = "greatest(0, " + ", ".join(f"CASE WHEN {_HIT[c]} THEN {('low', 'medium', 'high').index(r)} ELSE 0 END" for c, _, _, _, _, r in de.EVIDENCE) + ")"
_FAMILY = "CASE WHEN semantic IN ('medium', 'high') THEN 'meaning_loss' WHEN placeholder <> '' THEN 'placeholder' WHEN glossary <> '' THEN 'glossary' WHEN structure <> '' THEN 'structural' WHEN category IN ('grammar', 'style') THEN category ELSE 'generic' END"
_DECIDED = f"""SELECT *, CASE WHEN confidence >= 0.8 AND simple THEN 'auto_fix' WHEN confidence <= 0.3 THEN 'manual_review' ELSE 'ai_review' END AS route FROM
 (SELECT *, round(greatest(0, least(1, CAST({_SUM} AS DOUBLE))), 6) AS confidence, ['low', 'medium', 'high'][{_RISK} + 1] AS risk, {_FAMILY} AS family FROM ({_EVIDENCE}))"""
_RUNS = "SELECT CASE WHEN route = '' THEN 'unknown' ELSE route END AS project, CAST(date_trunc('day', ts) AS STRING) AS run, min(CAST(ts AS STRING)) AS ts, count(*) AS total, sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN rejected THEN 1 ELSE 0 END) AS rejected FROM (" + SIGNALS + ") GROUP BY 1, 2"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.decide(rows(spark, sf_dir, _EVIDENCE))


@query(f"SELECT id, confidence, risk, family, route FROM ({_DECIDED})")
def score_and_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("id", "confidence", "risk", "family", "route")


@query("WITH x AS (" + " UNION ALL ".join(f"SELECT id, '{s}' AS source, {i} AS p, '{c}' AS code, CAST({d} AS DOUBLE) AS delta FROM ({_EVIDENCE}) WHERE {_HIT[c]}" for i, (c, _, _, d, s, _) in enumerate(de.EVIDENCE)) + ") SELECT id, source, round(sum(delta), 6) AS total, string_agg(code, ',' ORDER BY p) AS codes FROM x GROUP BY id, source")
def contribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.contribution_summary(_decided(spark, sf_dir))


_METRICS = f"SELECT CASE WHEN route = '' THEN 'unknown' ELSE route END AS route, count(*) AS total, round(avg(CAST(accepted AS DOUBLE)), 4) AS acceptance_rate, round(avg(CAST(rejected AS DOUBLE)), 4) AS rejection_rate, round(avg(confidence), 4) AS avg_confidence FROM ({SIGNALS}) GROUP BY 1"


@query(_METRICS)
def feedback_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.feedback_metrics(rows(spark, sf_dir, SIGNALS))


@query(f"SELECT CASE WHEN risk = '' THEN 'unknown' ELSE risk END AS risk, count(*) AS total, count(*) FILTER (WHERE rejected) AS rejected, round(avg(CAST(rejected AS DOUBLE)), 4) AS rejection_rate FROM ({SIGNALS}) GROUP BY 1")
def rejection_by_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.rejection_by_risk(rows(spark, sf_dir, SIGNALS))


_CAL = f"SELECT route, round(0.8 + s, 6) AS threshold, round(s, 6) AS adjustment FROM (SELECT route, least(0.05, greatest(0, rejection_rate - 0.1)) AS s FROM ({_METRICS}) WHERE route = 'auto_fix')"


@query(_CAL)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.calibration(de.feedback_metrics(rows(spark, sf_dir, SIGNALS)))


@query(f"SELECT id, CASE WHEN route = 'auto_fix' AND confidence < (SELECT coalesce(max(threshold), 0.8) FROM ({_CAL})) THEN 'ai_review' ELSE route END AS route FROM ({_DECIDED})")
def calibrated_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.calibrate(_decided(spark, sf_dir), de.feedback_metrics(rows(spark, sf_dir, SIGNALS))).select("id", "route")


@query(f"SELECT id, round(CASE WHEN category = 'style' THEN greatest(0, confidence - 0.15) ELSE confidence END, 6) AS confidence, CASE WHEN route = 'auto_fix' AND risk <> 'low' THEN 'ai_review' ELSE route END AS route FROM ({_DECIDED})")
def context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.context_rules(_decided(spark, sf_dir)).select("id", "confidence", "route")


@query(f"SELECT count(*) FILTER (WHERE route = 'auto_fix') AS auto_fix, count(*) FILTER (WHERE route = 'ai_review') AS ai_review, count(*) FILTER (WHERE route = 'manual_review') AS manual_review, count(*) FILTER (WHERE risk = 'low') AS risk_low, count(*) FILTER (WHERE risk = 'medium') AS risk_medium, count(*) FILTER (WHERE risk = 'high') AS risk_high, round(avg(confidence), 4) AS average_confidence FROM ({_DECIDED})")
def routing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.routing_metrics(_decided(spark, sf_dir))


@query(f"SELECT r.route, b.band, count(d.id) AS n FROM (SELECT unnest(['auto_fix', 'ai_review', 'manual_review']) AS route) r CROSS JOIN (SELECT unnest(['low', 'mid', 'high']) AS band) b LEFT JOIN ({_DECIDED}) d ON d.route = r.route AND b.band = CASE WHEN confidence < 0.4 THEN 'low' WHEN confidence < 0.75 THEN 'mid' ELSE 'high' END GROUP BY r.route, b.band")
def decision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.decision_quality(_decided(spark, sf_dir))


_PROFILE = f"SELECT project, count(*) AS runs, round(avg(accepted / greatest(1, total)), 4) AS acceptance, round(avg(rejected / greatest(1, total)), 4) AS rejection FROM ({_RUNS}) GROUP BY project"


@query(_PROFILE)
def learning_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.learning_profile(rows(spark, sf_dir, _RUNS)).drop("first", "last")


_SIGNAL = f"SELECT project, signal FROM (SELECT *, CASE WHEN acceptance < 0.35 THEN 'low_acceptance' ELSE 'steady_acceptance' END AS signal FROM ({_PROFILE}) UNION ALL SELECT *, 'high_rejection' FROM ({_PROFILE}) WHERE rejection > 0.15) WHERE runs >= 5"


@query(f"SELECT project, signal, substr(sha256(project || ':' || signal), 1, 12) AS id FROM ({_SIGNAL})")
def adaptation_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.adaptation_signals(de.learning_profile(rows(spark, sf_dir, _RUNS)))


@query(f"SELECT project, signal, CASE WHEN project = 'unknown' THEN 'rejected_unknown_target' WHEN signal = 'steady_acceptance' THEN 'rejected_no_action' ELSE 'accepted' END AS verdict FROM ({_SIGNAL})")
def governance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return de.govern(de.adaptation_signals(de.learning_profile(rows(spark, sf_dir, _RUNS))))


@query(f"SELECT CAST(date_trunc('hour', ts) AS STRING) AS start, CASE WHEN route = '' THEN 'unknown' ELSE route END AS route, count(*) AS n, count(*) FILTER (WHERE accepted) AS accepted FROM ({SIGNALS}) GROUP BY 1, 2")
def windowed_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.streaming.feedback import windowed

    d = windowed(rows(spark, sf_dir, SIGNALS), "1 hour")
    return d.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "route", "n", "accepted")
