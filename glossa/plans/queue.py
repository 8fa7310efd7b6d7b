"""Queries on the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators import pairs as pr
from glossa.operators import queue as qu
from glossa.plans.adapters import FINDINGS, GLOSSARY, GLOSSED, PAIRS, rows, spread, table
from glossa.plans.pairs import _CODES
from glossa.plans.registry import query
from glossa.plans.texts import n_words, shape, strip

_KEY = "concat(CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'login.submitButton' WHEN 1 THEN 'dialogTitle' WHEN 2 THEN 'page.title' WHEN 3 THEN 'user_id' WHEN 4 THEN 'config.x' WHEN 5 THEN 'form.hint' WHEN 6 THEN 'push_body' ELSE 'k' END, '.', CAST(p_partkey AS STRING))"
_TOK = rf"list_filter(string_split(lower(regexp_replace(regexp_replace(k, '([0-9a-z])([A-Z])', '\1_\2', 'g'), '[^0-9A-Za-z]+', '_', 'g')), '_'), lambda x: x <> '')"
_HAVE = f"list_concat({_TOK}, list_transform(range(1, len({_TOK})), lambda i: {_TOK}[i] || '_' || {_TOK}[i + 1]))"
_TYPE = "CASE " + " ".join(f"WHEN list_has_any({_HAVE}, {words.split()}) THEN '{kind}'" for kind, words in qu.HINTS.items()) + f" WHEN {shape('p_name')} = 'sentence_like' THEN 'message' WHEN {shape('p_name')} = 'short_label' THEN 'label' ELSE 'unknown' END"


@query(f"SELECT p_partkey, {_TYPE} AS text_type, regexp_matches(lower(k), '^(config|setup|uuid|error_code|zone)') OR contains(lower(k), '_id') OR contains(lower(k), '_url') AS technical FROM (SELECT p_partkey, p_name, {_KEY} AS k FROM part)")
def text_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr(_KEY).alias("k"))).select("p_partkey", qu.text_type(k, F.col("p_name")).alias("text_type"), qu.technical_key(k).alias("technical"))


_CAND = """SELECT p_partkey AS id, concat('Use the API of iPhone for ', p_name, ' {x}') AS old, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN '' WHEN 1 THEN concat('Use the API of iPhone for ', p_name, ' {x}') WHEN 2 THEN concat('Use the API of iPhone for ', p_name)
  WHEN 3 THEN concat('Use the Api of iPhone for ', p_name, ' {x}') WHEN 4 THEN concat('Use the API of iPhone for ', p_name, ' {x} now') WHEN 5 THEN concat('Use  the API of iPhone for ', p_name, ' {x}') ELSE concat('Take the API of iPhone for ', p_name, ' {x}') END AS new,
  CASE WHEN p_size % 3 = 0 THEN 'high' ELSE 'low' END AS severity FROM part"""
_N = "[len(regexp_extract_all({c}, '\\{{[^{{}}]*\\}}')), len(regexp_extract_all({c}, '<[^>]+>')), len(regexp_extract_all({c}, '%[sd]'))]"
_LOST = rf"len(list_filter(regexp_extract_all(old, '\w+'), lambda w: regexp_matches(w, '{qu.PROTECTED}') AND NOT list_contains(regexp_extract_all(new, '\w+'), w))) > 0"
_REASON = f"CASE WHEN {strip('new')} = '' THEN 'empty' WHEN new = old THEN 'identical' WHEN {_N.format(c='old')} <> {_N.format(c='new')} THEN 'structure' WHEN {_LOST} THEN 'protected_token' WHEN starts_with(new, old || ' ') THEN 'appended' ELSE 'safe' END"
_DECISION = "CASE WHEN reason IN ('empty', 'identical') THEN 'none' WHEN reason = 'structure' THEN 'conflict' WHEN reason IN ('protected_token', 'appended') THEN 'veto' ELSE 'suggested_fix' END"


@query(rf"""SELECT id, decision, reason, CASE WHEN decision IN ('veto', 'conflict') THEN 'blocked' WHEN severity = 'high' THEN 'review_required' WHEN decision = 'suggested_fix' AND regexp_replace(old, '\s+', '', 'g') = regexp_replace(new, '\s+', '', 'g') THEN 'safe_auto_projected' ELSE 'suggestion_only' END AS quality
 FROM (SELECT *, {_DECISION} AS decision FROM (SELECT *, {_REASON} AS reason FROM ({_CAND})))""")
def candidate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = F.col("old"), F.col("new")
    d = rows(spark, sf_dir, _CAND).withColumn("c", qu.resolve_candidate(o, n))
    return d.select("id", "c.decision", "c.reason", qu.quality_class(F.col("c.decision"), F.col("severity"), tx.low_risk_edit(o, n)).alias("quality"))


_ASK = f"CASE WHEN issue_type IN ('unused_en', 'unused_ar', 'key_naming') THEN 'non_linguistic' WHEN issue_type IN ('whitespace', 'spacing') THEN 'format_only' WHEN issue_type = 'duplicate_value' THEN 'deterministic' WHEN issue_type = 'spelling' AND new <> '' THEN 'auto_safe' WHEN issue_type LIKE 'missing\\_%' ESCAPE '\\' OR issue_type LIKE 'empty\\_%' ESCAPE '\\' THEN 'missing' WHEN {n_words('old')} <= 1 THEN 'short_ambiguous' ELSE 'semantic_repair' END"


@query(f"SELECT seq, reason IN ('missing', 'semantic_repair') AS ask, reason FROM (SELECT seq, {_ASK} AS reason FROM ({FINDINGS}))")
def model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.ask_model(rows(spark, sf_dir, FINDINGS))


@query(f"""WITH m AS (SELECT key, string_agg(message, ' | ' ORDER BY seq) AS messages, array_to_string(list_sort(list(DISTINCT issue_type)), ',') AS issues, substr(sha256(key), 1, 1) AS b FROM ({FINDINGS}) GROUP BY key)
 SELECT key, b || '-' || CAST((row_number() OVER (PARTITION BY b ORDER BY key) - 1) // 20 AS STRING) AS batch, issues, messages FROM m""")
def model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.batches(rows(spark, sf_dir, FINDINGS), 20)


@query(f"SELECT key, CASE WHEN bad THEN 'rejected' WHEN codes <> '' THEN 'review' ELSE 'accepted' END AS decision, NOT bad AND codes = '' AS allow_apply, NOT bad AND codes <> '' AS needs_review FROM (SELECT key, codes, codes LIKE '%empty%' OR codes LIKE '%placeholder_loss%' OR codes LIKE '%tag_loss%' AS bad FROM (SELECT key, {_CODES} AS codes FROM ({PAIRS}) WHERE en IS NOT NULL AND ar IS NOT NULL))")
def model_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, PAIRS).where("en is not null and ar is not null")
    return d.select("key", qu.outcome(pr.gate_decision(pr.gate_codes(F.col("en"), F.col("ar")))).alias("x")).select("key", "x.*")


_ERR = "CASE event_type WHEN 'view' THEN 'HTTP 429 too many' WHEN 'click' THEN 'Unauthorized' WHEN 'purchase' THEN 'read timed out' ELSE 'boom' END"


@query("SELECT class, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'rate_limit' WHEN 'click' THEN 'auth' WHEN 'purchase' THEN 'timeout' ELSE 'other' END AS class FROM events) GROUP BY class")
def provider_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(qu.error_class(F.expr(_ERR)).alias("class")).agg(F.count("*").alias("n"))


@query(f"SELECT key, array_to_string(list_sort(list(DISTINCT term_en || '=' || approved)), ',') AS terms FROM ({GLOSSED}) s JOIN ({GLOSSARY}) g ON contains(lower(en), lower(term_en)) GROUP BY key")
def relevant_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.relevant_terms(rows(spark, sf_dir, GLOSSED), rows(spark, sf_dir, GLOSSARY))
