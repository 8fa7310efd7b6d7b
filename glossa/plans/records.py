"""Queries on records, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators import records as rc
from glossa.plans.adapters import FINDINGS, PAIRS, rows
from glossa.plans.registry import query
from glossa.plans.texts import strip, tech

_ISSUES = """SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN concat(' ', event_type) ELSE ' ' END AS locale, CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'Locale_QC ' WHEN 1 THEN 'terminology' ELSE 'other' END AS source,
  CASE WHEN event_id % 3 = 0 THEN concat('AR.k', CAST(user_id AS STRING)) ELSE 'k.x' END AS key, CASE WHEN event_id % 11 = 0 THEN '/app/en/x.json' WHEN event_id % 13 = 0 THEN 'lang_ar.json' END AS path,
  CASE WHEN event_id % 2 = 0 THEN 'AI_SUGGESTION' ELSE 'X' END AS code, CASE WHEN event_id % 17 = 1 THEN 'fr' END AS details FROM events"""


@query(f"""WITH w AS (SELECT seq, nullif({strip('locale')}, '') AS a, CASE lower({strip('source')}) WHEN 'locale_qc' THEN 'en' WHEN 'grammar' THEN 'en' WHEN 'ar_locale_qc' THEN 'ar' WHEN 'ar_semantic_qc' THEN 'ar' WHEN 'terminology' THEN 'ar' END AS b,
 CASE WHEN lower(split_part(key, '.', 1)) IN ('ar', 'en') THEN lower(split_part(key, '.', 1)) END AS c, CASE WHEN contains(path, '/ar/') OR ends_with(path, 'ar.json') THEN 'ar' WHEN contains(path, '/en/') OR ends_with(path, 'en.json') THEN 'en' END AS d, CASE WHEN code = 'AI_SUGGESTION' THEN 'ar' END AS e, details AS f FROM ({_ISSUES}))
 SELECT seq, coalesce(a, b, c, d, e, f) AS locale, CASE WHEN a IS NOT NULL THEN 'explicit' WHEN b IS NOT NULL THEN 'source_mapping' WHEN c IS NOT NULL THEN 'key_prefix' WHEN d IS NOT NULL THEN 'file_path' WHEN e IS NOT NULL THEN 'code_fallback' WHEN f IS NOT NULL THEN 'details_context' END AS by FROM w""")
def issue_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("locale", "source", "key", "path", "code", "details")]
    return rows(spark, sf_dir, _ISSUES).select("seq", rc.resolve_locale(*c).alias("x")).select("seq", "x.*")


_NAMED = "SELECT concat(CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'app.ratting_' WHEN 1 THEN 'pont.canot.' ELSE 'app.' END, CAST(p_partkey AS STRING)) AS key FROM part"


@query(" UNION ALL ".join(f"SELECT key, '{b}' AS bad, replace(key, '{b}', '{g}') AS new FROM ({_NAMED}) WHERE contains(key, '{b}')" for b, g in rc.KEY_NAMES))
def key_misspellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.key_names(rows(spark, sf_dir, _NAMED))


def _phrases(phrases: list[str]) -> str:
    """Rows whose text has each of the phrases in turn."""
    cases = " ".join(f"WHEN {i} THEN '{p.replace(chr(39), chr(39) * 2)}'" for i, p in enumerate(phrases))
    return f"SELECT concat('r.', CAST(p_partkey AS STRING)) AS key, concat('Note ', CAST(p_size AS STRING), ': ', CASE CAST(p_partkey % {len(phrases) + 1} AS INT) {cases} ELSE 'all is well' END, ' then') AS value FROM part"


def _word(p: str) -> str:
    return re.escape(p).replace("\\ ", " ").replace("'", "''")


_EDGE = r"[^\p{L}\p{N}_]"
_GRAMMAR = _phrases([p for p, _, _ in rc.GRAMMAR])


@query(" UNION ALL ".join(rf"SELECT key, '{t}' AS issue_type, '{p}' AS rule, value AS old, regexp_replace(value, '(?i)(^|{_EDGE}){_word(p)}($|{_EDGE})', '\1{r}\2', 'g') AS new FROM ({_GRAMMAR}) WHERE regexp_matches(value, '(?i)(^|{_EDGE}){_word(p)}($|{_EDGE})')" for p, r, t in rc.GRAMMAR))
def grammar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.grammar(rows(spark, sf_dir, _GRAMMAR))


_WORDING = _phrases([p for _, p, _, _ in tx.WORDING])


@query(" UNION ALL ".join(rf"SELECT key, '{t}' AS issue_type, '{m}' AS message, value AS old, regexp_replace(value, '(?i)(^|{_EDGE}){_word(p)}($|{_EDGE})', '\1{r.replace(chr(39), chr(39) * 2)}\2', 'g') AS new FROM ({_WORDING}) WHERE NOT {tech('value')} AND regexp_matches(value, '(?i)(^|{_EDGE}){_word(p)}($|{_EDGE})')" for t, p, r, m in tx.WORDING))
def wording_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _WORDING).select("key", F.col("value").alias("old"), F.explode(tx.wording_issues(F.col("value"))).alias("x")).select("key", "x.issue_type", "x.message", "old", "x.new")


_SENTENCES = "SELECT concat('s.', CAST(p_partkey AS STRING)) AS key, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN concat(lower(p_name), ' is here.') WHEN 1 THEN concat(p_name, '!') WHEN 2 THEN concat(lower(p_name), ' {x} is here.') ELSE ' ok.' END AS value FROM part"


@query(rf"SELECT key, upper(substr(s, 1, 1)) || substr(s, 2) AS new FROM (SELECT key, {strip('value')} AS s FROM ({_SENTENCES})) WHERE regexp_matches(s, '^\p{{Ll}}') AND len(regexp_extract_all(s, '[A-Za-z][A-Za-z'']*')) >= 2 AND regexp_matches(s, '[.?!]') AND NOT {tech('s')} AND NOT regexp_matches(s, '[<>{{}}%$]')")
def lower_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.lower_start(rows(spark, sf_dir, _SENTENCES))


_COLS = "seq, source, key, locale, issue_type, severity, message, old, new"


@query(" UNION ALL ".join(f"SELECT {_COLS} FROM ({FINDINGS}) WHERE source = '{s}' QUALIFY row_number() OVER (PARTITION BY {', '.join(rc.SAME[s])} ORDER BY seq) = 1" for s in ("placeholders", "locale_qc", "ar_locale_qc", "terminology")))
def audit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.dedupe_by_audit(rows(spark, sf_dir, FINDINGS)).select(*_COLS.split(", "))


@query(f"SELECT severity, key, issue_type, message FROM ({FINDINGS}) WHERE source = 'placeholders' ORDER BY 1, 2, 3")
def placeholder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.report(rows(spark, sf_dir, FINDINGS), "placeholders").select("severity", "key", "issue_type", "message")


@query(f"SELECT locale, key, issue_type, seq FROM ({FINDINGS}) ORDER BY 1, 2, 3")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.report(rows(spark, sf_dir, FINDINGS), "review_queue").select("locale", "key", "issue_type", "seq")


@query(f"SELECT source, count(DISTINCT key) AS keys, count(*) AS findings, (SELECT string_agg(issue_type || '=' || n, ' ' ORDER BY issue_type) FROM (SELECT issue_type, CAST(count(*) AS VARCHAR) AS n FROM ({FINDINGS}) g WHERE g.source = f.source GROUP BY issue_type)) AS issue_types FROM ({FINDINGS}) f GROUP BY source")
def summary_by_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.audit_summary(rows(spark, sf_dir, FINDINGS))


_SIG = "SELECT concat('part.', CAST(user_id AS STRING)) AS key, CAST(event_id % 3 AS BIGINT) AS style, CAST(event_id % 2 AS BIGINT) AS grammar, event_id % 29 = 0 AS literal, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('R', CAST(event_id % 6 AS STRING)) END AS rule, event_type AS source FROM events"
_SIG_SQL = f"SELECT key, CAST(sum(style) AS BIGINT) AS style, CAST(sum(grammar) AS BIGINT) AS grammar, bool_or(literal) AS literal, array_to_string(list_sort(list(DISTINCT rule) FILTER (rule <> '')), ',') AS rules, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM ({_SIG}) GROUP BY key"


@query(_SIG_SQL.replace("array_to_string(list_sort(list(DISTINCT rule)", "coalesce(array_to_string(list_sort(list(DISTINCT rule)").replace("FILTER (rule <> '')), ',')", "FILTER (rule <> '')), ','), '')"))
def merged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, _SIG)
    return rc.merge_signals(d.where("source in ('view', 'click')"), d.where("source not in ('view', 'click')"))


@query(f"SELECT p.key, coalesce(s.style, 0) AS style, coalesce(s.grammar, 0) AS grammar, coalesce(s.literal, false) AS literal FROM ({PAIRS}) p LEFT JOIN ({_SIG_SQL}) s ON p.key = s.key")
def pairs_with_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rc.merge_signals(rows(spark, sf_dir, _SIG)).select("key", "style", "grammar", "literal")
    return rc.with_signals(rows(spark, sf_dir, PAIRS).select("key"), s)


_FLAGGED = "SELECT concat('f.', CAST(p_partkey AS STRING)) AS key, concat('The Driver paid ', p_name, ' to the customer') AS en, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'driver السائق' WHEN 1 THEN 'الشركة' ELSE 'نص' END AS ar FROM part"


@query(f"SELECT key, concat_ws(' ', CASE WHEN contains(lower(en), 'almond') THEN 'en:almond' END, CASE WHEN contains(lower(en), 'customer') THEN 'en:customer' END, CASE WHEN contains(lower(en), 'driver') THEN 'en:driver' END, CASE WHEN contains(ar, 'customer') THEN 'ar_person:customer' END, CASE WHEN contains(ar, 'driver') THEN 'ar_person:driver' END, CASE WHEN contains(ar, 'الشركة') THEN 'ar_entity:الشركة' END) AS flags FROM ({_FLAGGED})")
def term_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _FLAGGED).select("key", F.array_join(rc.term_flags(F.col("en"), F.col("ar"), ("driver", "customer"), ("almond",), ("الشركة",)), " ").alias("flags"))


_HINTS = "SELECT user_id, array_sort(collect_set(event_type)) AS h FROM events GROUP BY user_id"


@query("SELECT user_id, coalesce(min(event_type) FILTER (event_type NOT IN ('', 'generic', 'unknown')), 'generic') AS hint FROM events GROUP BY user_id")
def dominant_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _HINTS).select("user_id", rc.dominant(F.col("h")).alias("hint"))


_QUEUE_ROWS = f"""SELECT seq, key, locale, issue_type, severity, old, new AS suggested, CASE CAST(seq % 6 AS INT) WHEN 0 THEN '[CONFLICT: span]' WHEN 1 THEN 'safety_gate: tags' WHEN 2 THEN '[DQ:BLOCKED] x' ELSE '' END AS notes,
  CASE WHEN seq % 10 = 3 THEN 'camel_validation' ELSE source END AS provenance, CASE WHEN seq % 3 = 0 THEN 'Yes' ELSE 'No' END AS needs_review, CASE CAST(seq % 4 AS INT) WHEN 0 THEN 'ai_review' WHEN 1 THEN 'auto_fix' WHEN 2 THEN 'manual_review' END AS route FROM ({FINDINGS})"""


@query(f"SELECT seq FROM ({_QUEUE_ROWS}) WHERE (suggested <> '' AND suggested <> old) OR contains(notes, '[CONFLICT:') OR contains(notes, 'safety_gate') OR contains(provenance, 'camel_validation')")
def meaningful_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.meaningful(rows(spark, sf_dir, _QUEUE_ROWS)).select("seq")


@query(f"SELECT key, locale, issue_type, old AS current_value, suggested AS candidate_value, notes AS review_note FROM ({_QUEUE_ROWS}) WHERE NOT contains(provenance, 'camel_validation')")
def human_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.human_queue(rows(spark, sf_dir, _QUEUE_ROWS))


@query(f"SELECT count(*) FILTER (severity IN ('critical', 'high')) AS critical, count(*) FILTER (needs_review = 'No') AS safe, count(*) FILTER (needs_review = 'Yes') AS review, count(*) FILTER (contains(notes, '[DQ:BLOCKED]')) AS blocked, count(*) AS total FROM ({_QUEUE_ROWS})")
def payload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.payload_counts(rows(spark, sf_dir, _QUEUE_ROWS))


_TRACES = "SELECT event_id % 3 <> 0 AS invoked, CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'suspicious' WHEN 'error' THEN 'rejected' END AS outcome FROM events"


@query(f"SELECT count(*) FILTER (invoked) AS invoked, count(*) FILTER (NOT invoked) AS skipped, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'suspicious') AS suspicious, count(*) FILTER (outcome = 'rejected') AS rejected FROM ({_TRACES})")
def decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.decision_metrics(rows(spark, sf_dir, _TRACES))


@query(f"SELECT seq FROM ({_QUEUE_ROWS}) WHERE coalesce(route, 'auto_fix') = 'auto_fix'")
def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.of_stage(rows(spark, sf_dir, _QUEUE_ROWS), "auto_fix").select("seq")


@query(f"SELECT key, locale, issue_type, seq, old FROM (SELECT key, locale, issue_type, seq, old FROM ({FINDINGS})) QUALIFY row_number() OVER (PARTITION BY key, locale, issue_type ORDER BY seq DESC) = 1")
def queue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.last_of(rows(spark, sf_dir, FINDINGS).select("key", "locale", "issue_type", "seq", "old"), ["key", "locale", "issue_type"], "seq")


_CAND = f"SELECT seq, key, locale, new AS value FROM ({FINDINGS}) WHERE new <> ''"
_STAGED = "SELECT DISTINCT concat('k.', CAST(user_id % 211 AS STRING)) AS key, 'ar' AS locale, concat('staged ', CAST(user_id % 211 AS STRING)) AS value FROM events WHERE user_id % 211 < 60"


@query(f"SELECT coalesce(s.key, c.key) AS key, coalesce(s.locale, c.locale) AS locale, coalesce(s.value, c.value) AS value, CASE WHEN s.key IS NOT NULL THEN 'staged' ELSE 'candidate' END AS origin FROM ({_STAGED}) s FULL JOIN (SELECT key, locale, arg_min(value, seq) AS value FROM ({_CAND}) GROUP BY key, locale) c ON s.key = c.key AND s.locale = c.locale")
def staged_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.with_staged(rows(spark, sf_dir, _CAND), rows(spark, sf_dir, _STAGED))


_MASTER = "SELECT concat('p', CAST(p_partkey AS STRING)) AS plan_id, p_name AS approved, 'pending' AS status FROM part"
_FROZEN = "SELECT CASE WHEN l_orderkey % 50 = 0 THEN '' ELSE concat('p', CAST(l_partkey AS STRING)) END AS plan_id, l_orderkey * 10 + l_linenumber AS seq, concat('v', CAST(l_orderkey AS STRING)) AS approved, CASE WHEN l_orderkey % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status FROM lineitem WHERE l_partkey % 3 = 0"


@query(f"WITH f AS (SELECT plan_id, arg_min(approved, seq) AS approved, arg_min(status, seq) AS status FROM ({_FROZEN}) WHERE plan_id <> '' GROUP BY plan_id) SELECT m.plan_id, coalesce(f.approved, m.approved) AS approved, coalesce(f.status, m.status) AS status FROM ({_MASTER}) m LEFT JOIN f ON m.plan_id = f.plan_id")
def updated_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.update_master(rows(spark, sf_dir, _MASTER), rows(spark, sf_dir, _FROZEN))


@query(f"SELECT 'locale' AS rule, count(*) FILTER (locale <> 'ar') AS bad FROM ({FINDINGS}) UNION ALL SELECT 'new', count(*) FILTER (new = '') FROM ({FINDINGS}) UNION ALL SELECT 'severity', count(*) FILTER (severity = '') FROM ({FINDINGS})")
def artifact_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.contract(rows(spark, sf_dir, FINDINGS), "locale", "ar", ["new", "severity"])


def _replaced(c: str) -> str:
    for wrong in sorted(tx.SAFE_REPLACEMENTS, key=len, reverse=True):
        c = f"replace({c}, '{wrong}', '{tx.SAFE_REPLACEMENTS[wrong].replace(chr(39), chr(39) * 2)}')"
    return c


@query(f"SELECT * FROM (SELECT key, 'trim' AS kind, {strip('en')} AS new, en FROM ({PAIRS}) UNION ALL SELECT key, 'collapse', regexp_replace(en, ' {{2,}}', ' ', 'g'), en FROM ({PAIRS}) UNION ALL SELECT key, 'replacement', {_replaced('en')}, en FROM ({PAIRS})) WHERE new <> en".replace("SELECT *", "SELECT key, kind, new", 1))
def safety_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.safety_pass(rows(spark, sf_dir, PAIRS).select("key", F.col("en").alias("value")))


_FIELDS = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_name END AS a, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS b, CASE WHEN p_partkey % 5 = 0 THEN concat(' ', p_type, ' ') END AS c FROM part"


@query(f"SELECT p_partkey, coalesce(nullif({strip('a')}, ''), nullif({strip('b')}, ''), nullif({strip('c')}, ''), '') AS context FROM ({_FIELDS})")
def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _FIELDS).select("p_partkey", rc.context_text(F.col("a"), F.col("b"), F.col("c")).alias("context"))


_DONE = "SELECT concat('p', CAST(p_partkey AS STRING)) AS plan_id, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'accepted' WHEN 1 THEN 'key_drift' ELSE 'no_change' END AS reason, p_name AS approved FROM part"


@query(f"SELECT plan_id, CASE WHEN reason = 'accepted' THEN 'applied' ELSE 'rejected' END AS outcome, CASE WHEN reason = 'accepted' THEN approved ELSE reason END AS detail FROM ({_DONE})")
def apply_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.trace(rows(spark, sf_dir, _DONE))
