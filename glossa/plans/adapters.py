"""Catalogs, findings, signals and glossaries made of the driver's tables.

Each adapter is one SELECT that Spark and DuckDB both understand, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EN = """CASE CAST(p_partkey % 14 AS INT)
  WHEN 0 THEN concat('Hello {name}, you have {count} items of ', p_name, '.')
  WHEN 1 THEN 'Total %s for %1$s'
  WHEN 2 THEN concat('{{user}} paid $', '{amount} today')
  WHEN 3 THEN 'Ride :id to :city'
  WHEN 4 THEN concat(p_name, '  twice')
  WHEN 5 THEN 'Save your profile to continue.'
  WHEN 6 THEN concat(' ', p_name)
  WHEN 7 THEN 'Contact with us everyday'
  WHEN 8 THEN 'You can not enter the pont'
  WHEN 9 THEN p_name
  WHEN 10 THEN 'Select {count} of {total}'
  WHEN 11 THEN 'Delete after 2hours!!'
  WHEN 12 THEN 'See https://example.org/help or run npm install'
  ELSE concat('Send The ', p_brand, ' Order Now') END"""
_AR = f"""CASE CAST(p_partkey % 5 AS INT)
  WHEN 0 THEN {_EN}
  WHEN 1 THEN replace(replace({_EN}, '{{name}}', '{{label}}'), ':id', ':code')
  WHEN 2 THEN concat('احفظ الملف ', replace(replace({_EN}, '{{count}}', ''), '%s', ''))
  WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END
  ELSE concat('أرسل  ', CAST(p_size AS STRING), ' ؟') END"""

#: Pairs of a catalog: id, key, en, ar; either side can be missing.
PAIRS = f"""SELECT p_partkey AS id, concat('part.', CAST(p_partkey AS STRING)) AS key,
  CASE WHEN p_partkey % 17 <> 0 THEN {_EN} END AS en, CASE WHEN p_partkey % 13 <> 0 THEN {_AR} END AS ar FROM part"""
#: Entries of the source language from documents.
DOCS = "SELECT doc_id AS id, concat('doc.', CAST(doc_id AS STRING)) AS key, lang AS locale, text AS value FROM documents"
#: Turns with the next turn of their conversation as translation.
TURNS = "SELECT a.conv_id, a.turn, concat(CAST(a.conv_id AS STRING), '.', CAST(a.turn AS STRING)) AS key, a.text AS en, b.text AS ar FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'"
#: Findings: seq, source, key, locale, issue_type, severity, message, old, new.
FINDINGS = """SELECT event_id AS seq,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'locale_qc' WHEN 1 THEN 'ar_locale_qc' WHEN 2 THEN 'terminology' ELSE 'placeholders' END AS source,
  concat('k.', CAST(user_id % 211 AS STRING)) AS key,
  CASE WHEN event_id % 4 = 0 THEN 'en' ELSE 'ar' END AS locale,
  CASE CAST((event_id + user_id) % 9 AS INT) WHEN 0 THEN 'whitespace' WHEN 1 THEN 'spelling' WHEN 2 THEN 'grammar' WHEN 3 THEN 'forbidden_term'
    WHEN 4 THEN 'missing_in_ar' WHEN 5 THEN 'duplicate_value' WHEN 6 THEN 'empty_ar' WHEN 7 THEN 'style' ELSE 'unused_en' END AS issue_type,
  CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'HIGH' WHEN 1 THEN 'warning' WHEN 2 THEN 'low' WHEN 3 THEN 'info' WHEN 4 THEN '' ELSE 'critical' END AS severity,
  concat('m', CAST(user_id % 3 AS STRING)) AS message, concat('old ', CAST(user_id % 5 AS STRING)) AS old,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('old ', CAST(event_id % 3 AS STRING)) END AS new FROM events"""
#: Feedback signals: id, ts, route, risk, source, confidence, accepted, rejected.
SIGNALS = """SELECT event_id AS id, ts, CASE event_type WHEN 'view' THEN 'auto_fix' WHEN 'click' THEN 'ai_review' WHEN 'purchase' THEN 'manual_review' ELSE '' END AS route,
  CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE '' END AS risk,
  CASE WHEN user_id % 2 = 0 THEN 'grammar' ELSE 'locale_qc' END AS source, abs(value) / (1 + abs(value)) AS confidence,
  event_id % 3 = 0 AS accepted, event_id % 3 = 1 AND user_id % 2 = 0 AS rejected FROM events"""
#: Glossary: ord, term_en, approved, forbidden.
GLOSSARY = "SELECT n_nationkey AS ord, n_name AS term_en, concat('ok_', lower(n_name)) AS approved, concat('bad_', lower(n_name)) AS forbidden FROM nation"
#: Texts that use the glossary's terms: key, en, ar.
GLOSSED = """SELECT concat('s.', CAST(s_suppkey AS STRING)) AS key, concat('Ship to ', n_name, ' with ', s_name) AS en,
  CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN concat('x ok_', lower(n_name), ' y') WHEN 1 THEN concat('x bad_', lower(n_name), ' y') ELSE 'nothing here' END AS ar
  FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
#: Catalog keys, and lines of source code that use them.
KEYS = "SELECT concat('orders.', lower(replace(o_orderpriority, ' ', '_')), '.', CAST(o_orderkey AS STRING)) AS key, o_orderkey AS id FROM orders"
LINES = """SELECT l_orderkey AS id, l_linenumber AS line, CASE CAST(l_partkey % 5 AS INT)
  WHEN 0 THEN concat('Text("orders.', CAST(l_orderkey AS STRING), '".tr)')
  WHEN 1 THEN concat('t("', CAST(l_orderkey AS STRING), '")')
  WHEN 2 THEN concat('Button(label: __("k.', CAST(l_partkey % 97 AS STRING), '"))')
  WHEN 3 THEN concat('showDialog(title: t("k.', CAST(l_suppkey AS STRING), '"))')
  ELSE concat('t("status_" + s', CAST(l_linenumber AS STRING), ')') END AS code FROM lineitem"""


def rows(spark: SparkSession, sf_dir: str, sql: str, costly: bool = False) -> DataFrame:
    """The rows of an adapter over the tables of a folder; only the columns and tables that it names are read. For costly rules the tables are spread first."""
    read = lambda n: spread(table(spark, sf_dir, n)) if costly else table(spark, sf_dir, n)
    names = [n for n in ("documents", "conversations", "events", "part", "supplier", "nation", "orders", "lineitem", "pages", "labels", "customer", "region") if f" {n}" in sql]
    return spark.sql(_with_tables(sql, names), **{n: read(n) for n in names})


def spread(d: DataFrame) -> DataFrame:
    """The same rows over all cores, as often as the session shuffles. A narrow table has a million rows in one row group, which a single task reads; rules that cost much a row mustn't be left to it."""
    spark = d.sparkSession
    return d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _with_tables(sql: str, names: list[str]) -> str:
    import re

    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    # other braces are the texts' own
    marks = {f"{{{n}}}": f"\0{i}\0" for i, n in enumerate(names)}
    for a, b in marks.items():
        sql = sql.replace(a, b)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for a, b in marks.items():
        sql = sql.replace(b, a)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
