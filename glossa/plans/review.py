"""Queries on key resolution, review and the merge of fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import review as rv
from glossa.plans.adapters import FINDINGS, PAIRS, SIGNALS, rows
from glossa.plans.registry import query

_CATALOG = "SELECT concat(CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'app.' WHEN 1 THEN 'web.home.' ELSE '' END, 'item.', CAST(p_partkey // 2 AS STRING)) AS key FROM part"
_CATALOG_SPARK = _CATALOG.replace("p_partkey // 2", "p_partkey div 2")
_ASKED = "SELECT CASE WHEN o_orderkey % 50 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN concat('app.item.', CAST(o_custkey AS STRING)) ELSE concat('item.', CAST(o_custkey AS STRING)) END AS key FROM orders"
_EN = f"SELECT key, 'en' AS locale, en AS value FROM ({PAIRS}) WHERE en IS NOT NULL"
_PART_FINDINGS = "SELECT seq, concat('part.', CAST(seq % 3000 AS STRING)) AS key, 'en' AS locale, issue_type FROM (" + FINDINGS + ")"
_QUEUE = "SELECT concat('p', CAST(p_partkey AS STRING)) AS plan_id, concat('k.', CAST(p_partkey AS STRING)) AS key, p_name AS current, p_type AS hash FROM part"
_BOOK = """SELECT concat('p', CAST(p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 1000000 ELSE 0 END AS STRING)) AS plan_id, CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 17 = 0 THEN 'k.x' ELSE concat('k.', CAST(p_partkey AS STRING)) END AS key,
  CASE WHEN p_partkey % 7 = 0 THEN 'fr' ELSE 'ar' END AS locale, CASE WHEN p_partkey % 5 = 0 THEN 'rejected' ELSE 'approved' END AS status,
  CASE WHEN p_partkey % 19 = 0 THEN p_name ELSE upper(p_name) END AS approved, CASE WHEN p_partkey % 23 = 0 THEN p_brand ELSE p_name END AS current FROM part"""
_STATE = "SELECT concat('p', CAST(p_partkey AS STRING)) AS plan_id, CASE WHEN p_partkey % 4 = 0 THEN 'other' ELSE p_type END AS hash, CASE WHEN p_size > 25 THEN 'approved' ELSE 'rejected' END AS status FROM part WHERE p_size > 10"


@query(f"""WITH c AS (SELECT DISTINCT key FROM ({_CATALOG})), s AS (SELECT key AS fk, array_to_string(string_split(key, '.')[unnest(range(2, len(string_split(key, '.')) + 1)):], '.') AS k FROM c), g AS (SELECT k, count(*) AS n, min(fk) AS one FROM s GROUP BY k),
 r AS (SELECT DISTINCT key FROM ({_ASKED})), j AS (SELECT r.key, c.key IS NOT NULL AS direct, n, one FROM r LEFT JOIN c ON r.key = c.key LEFT JOIN g ON g.k = r.key)
 SELECT key, CASE WHEN key = '' THEN 'empty' WHEN direct THEN 'direct' WHEN n = 1 THEN 'suffix' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN key = '' THEN NULL WHEN direct THEN key WHEN n = 1 THEN one END AS found FROM j""")
def suffix_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.resolve_suffixes(rows(spark, sf_dir, _ASKED), rows(spark, sf_dir, _CATALOG_SPARK))


@query(f"SELECT f.seq, f.key, coalesce(e.value, '') AS current, sha256(coalesce(e.value, '')) AS source_hash FROM ({_PART_FINDINGS}) f LEFT JOIN ({_EN}) e ON f.key = e.key AND f.locale = e.locale")
def hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.hydrate(rows(spark, sf_dir, _PART_FINDINGS), rows(spark, sf_dir, _EN)).select("seq", "key", "current", "source_hash")


@query(f"SELECT DISTINCT f.key, e.value AS suggestion FROM ({_PART_FINDINGS}) f JOIN ({_EN}) e ON f.key = e.key WHERE issue_type IN ('missing_in_ar', 'missing_ar')")
def cross_locale_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.cross_locale_suggestions(rows(spark, sf_dir, _PART_FINDINGS), rows(spark, sf_dir, _EN))


@query(f"SELECT q.plan_id, CASE WHEN s.status IS NULL THEN 'pending' WHEN s.hash <> q.hash THEN 'stale' ELSE s.status END AS status FROM ({_QUEUE}) q LEFT JOIN ({_STATE}) s ON q.plan_id = s.plan_id")
def workflow_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.overlay(rows(spark, sf_dir, _QUEUE), rows(spark, sf_dir, _STATE)).select("plan_id", "status")


@query(f"""SELECT b.plan_id, CASE WHEN b.plan_id = '' OR b.key = '' THEN 'missing_field' WHEN q.key IS NULL THEN 'unknown_plan_id' WHEN q.key <> b.key THEN 'key_drift' WHEN q.current <> b.current THEN 'source_drift'
 WHEN b.locale NOT IN ('ar', 'en') THEN 'bad_locale' WHEN b.status <> 'approved' THEN 'not_approved' WHEN b.approved = b.current THEN 'no_change' ELSE 'accepted' END AS reason FROM ({_BOOK}) b LEFT JOIN ({_QUEUE}) q ON b.plan_id = q.plan_id""")
def prepare_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.prepare_gate(rows(spark, sf_dir, _BOOK), rows(spark, sf_dir, _QUEUE))


_AUTO, _REVIEWED = "SELECT concat('part.', CAST(p_partkey AS STRING)) AS key, upper(p_name) AS value FROM part WHERE p_size > 20", "SELECT concat('part.', CAST(p_partkey AS STRING)) AS key, p_type AS value FROM part WHERE p_size < 30"


@query(f"SELECT b.key, coalesce(r.value, a.value, b.value) AS value, CASE WHEN r.value IS NOT NULL THEN 'review' WHEN a.value IS NOT NULL THEN 'auto' ELSE 'base' END AS origin FROM ({_EN}) b LEFT JOIN ({_AUTO}) a ON a.key = b.key LEFT JOIN ({_REVIEWED}) r ON r.key = b.key")
def fix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.merge_fixes(rows(spark, sf_dir, _EN), rows(spark, sf_dir, _AUTO), rows(spark, sf_dir, _REVIEWED))


@query(f"SELECT b.plan_id, CASE WHEN q.plan_id IS NOT NULL THEN 'allowed' ELSE 'stale' END AS state FROM ({_BOOK}) b LEFT JOIN ({_QUEUE}) q ON b.plan_id = q.plan_id")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.reconcile(rows(spark, sf_dir, _BOOK), rows(spark, sf_dir, _QUEUE))


@query(f"SELECT id, route AS project FROM ({SIGNALS}) QUALIFY row_number() OVER (PARTITION BY route ORDER BY ts DESC, id DESC) <= 500")
def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, SIGNALS).withColumnRenamed("route", "project")
    return rv.last_runs(d, 500).select("id", "project")  # the history's length
