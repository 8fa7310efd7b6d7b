"""Queries on reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import reports as rp
from glossa.plans.adapters import FINDINGS, rows, table
from glossa.plans.decisions import _DECIDED, _decided
from glossa.plans.findings import _NORMAL, _found
from glossa.plans.registry import query

_RAW = "SELECT concat('part.', CAST(p_partkey AS STRING)) AS key, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ' ' END AS current_value, p_type AS target, CASE WHEN p_size > 20 THEN p_brand END AS candidate, p_name AS suggestion, 'style' AS violation_type, p_brand AS reason FROM part"


@query(f"SELECT 'terminology' AS source, key, 'ar' AS locale, violation_type AS issue_type, '' AS severity, reason AS message, CASE WHEN trim(current_value) <> '' THEN current_value ELSE target END AS old, coalesce(candidate, suggestion) AS new FROM ({_RAW})")
def tool_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.from_tool(rows(spark, sf_dir, _RAW), "terminology", "ar")


@query(f"SELECT 'grammar' AS source WHERE NOT EXISTS (SELECT 1 FROM ({FINDINGS}) WHERE source = 'grammar') UNION ALL SELECT 'terminology' WHERE NOT EXISTS (SELECT 1 FROM ({FINDINGS}) WHERE source = 'terminology')")
def missing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.missing_reports(rows(spark, sf_dir, FINDINGS), ["grammar", "terminology"])


@query(rf"SELECT seq FROM ({_NORMAL}) WHERE severity <> 'info' AND NOT (issue_type = 'capitalization' AND regexp_matches(key, '_(label|btn|hint)$'))")
def visible_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.suppress_noise(_found(spark, sf_dir)).select("seq")


_EVIDENCE = "SELECT c_mktsegment AS root, concat('profile', CAST(c_custkey % 5 AS STRING)) AS profile, CAST(c_custkey % 31 AS BIGINT) AS points FROM customer"


@query(f"""WITH g AS (SELECT root, profile, CAST(sum(points) AS BIGINT) AS score, count(*) AS reasons FROM ({_EVIDENCE}) GROUP BY root, profile),
 r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM g WINDOW w AS (PARTITION BY root ORDER BY score DESC, reasons DESC, profile))
 SELECT root, profile, score, second FROM r WHERE k = 1 AND score >= 35 AND score - second >= 10""")
def project_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.detect_profile(rows(spark, sf_dir, _EVIDENCE))


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM ({_DECIDED}) GROUP BY {c}" for c in ("family", "route", "risk")))
def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.snapshot(_decided(spark, sf_dir))


@query(f"SELECT key || '|' || locale || '|' || sha256(new) AS id, min(seq) AS seq FROM ({FINDINGS}) GROUP BY 1")
def distinct_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.distinct_mutations(rows(spark, sf_dir, FINDINGS).withColumnRenamed("new", "approved"))


@query("SELECT p_partkey, substr(p_name, 1, p_size % 5) || '<' || p_brand || '>' || substr(p_name, p_size % 5 + 3 + 1) AS text FROM part")
def spliced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rp.splice(F.col("p_name"), F.col("p_size") % 5, F.lit(3), F.concat(F.lit("<"), "p_brand", F.lit(">"))).alias("text"))


@query(f"SELECT seq, '- **' || severity || '** `' || key || '` (' || issue_type || '): ' || message AS line FROM ({_NORMAL})")
def issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("seq", rp.issue_line().alias("line"))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS changes, count(*) FILTER (WHERE n > 1) AS contested, CAST(sum(n - 1) AS BIGINT) AS rejected FROM (SELECT count(*) AS n FROM ({_NORMAL}) GROUP BY key, old)")
def conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.conflict_counts(_found(spark, sf_dir))


_ANSWERS = "SELECT concat('k.', CAST(c_custkey AS STRING)) AS key, c_name AS suggestion FROM customer"


@query(f"SELECT f.seq, f.key, a.suggestion FROM ({FINDINGS}) f JOIN ({_ANSWERS}) a ON f.key = a.key")
def answered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, FINDINGS).select("seq", "key").join(rows(spark, sf_dir, _ANSWERS), "key")
