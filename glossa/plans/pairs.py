"""Queries on pairs of catalogs and on glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators import glossary as gl
from glossa.operators import pairs as pr
from glossa.plans.adapters import GLOSSARY, GLOSSED, PAIRS, TURNS, rows
from glossa.plans.registry import query
from glossa.plans.texts import _TOKEN, n_words, shape, strip, tech

_E, _A = f"SELECT key, en AS value FROM ({PAIRS}) WHERE en IS NOT NULL", f"SELECT key, ar AS value FROM ({PAIRS}) WHERE ar IS NOT NULL"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rows(spark, sf_dir, _E), rows(spark, sf_dir, _A)


@query(f"SELECT coalesce(e.key, a.key) AS key, coalesce(e.value, '') AS en, coalesce(a.value, '') AS ar FROM ({_E}) e FULL JOIN ({_A}) a ON e.key = a.key")
def full_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.full_pair(*_sides(spark, sf_dir))


@query(f"SELECT e.key, e.value AS en, coalesce(a.value, '') AS ar FROM ({_E}) e LEFT JOIN ({_A}) a ON e.key = a.key")
def en_driven_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.driven_pair(*_sides(spark, sf_dir))


@query(f"SELECT a.key, a.value AS ar, coalesce(e.value, '') AS en FROM ({_A}) a LEFT JOIN ({_E}) e ON e.key = a.key")
def ar_driven_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.driven_pair(*_sides(spark, sf_dir)[::-1], names=("ar", "en"))


@query(f"SELECT e.key, e.value AS en, a.value AS ar FROM ({_E}) e JOIN ({_A}) a ON e.key = a.key WHERE {strip('e.value')} <> '' AND {strip('a.value')} <> ''")
def both_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.both_present(*_sides(spark, sf_dir))


@query(f"SELECT DISTINCT key FROM ({_E}) e WHERE key NOT IN (SELECT key FROM ({_A}))")
def missing_in_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.missing(*_sides(spark, sf_dir))


@query(f"SELECT DISTINCT key FROM ({_A}) e WHERE key NOT IN (SELECT key FROM ({_E}))")
def missing_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.missing(*_sides(spark, sf_dir)[::-1])


@query(rf"SELECT key, en FROM ({PAIRS}) WHERE en = ar AND {strip('en')} <> '' AND regexp_matches(en, '\p{{L}}')")
def identical_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.identical(rows(spark, sf_dir, PAIRS)).select("key", "en")


@query(f"SELECT key, CASE WHEN en IS NULL THEN 'missing_en' WHEN ar IS NULL THEN 'missing_ar' WHEN {strip('en')} = '' THEN 'empty_en' ELSE 'empty_ar' END AS issue_type FROM ({PAIRS}) WHERE en IS NULL OR ar IS NULL OR {strip('en')} = '' OR {strip('ar')} = ''")
def empty_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, a = F.col("en"), F.col("ar")
    kind = F.when(e.isNull(), "missing_en").when(a.isNull(), "missing_ar").when(tx.is_blank(e), "empty_en").when(tx.is_blank(a), "empty_ar")
    return rows(spark, sf_dir, PAIRS).select("key", kind.alias("issue_type")).where("issue_type is not null")


@query(rf"""SELECT key, 'whitespace' AS issue_type, en AS old, {strip('en')} AS new FROM ({PAIRS}) WHERE {strip('en')} <> en UNION ALL
 SELECT key, 'spacing', en, regexp_replace(en, ' {{2,}}', ' ', 'g') FROM ({PAIRS}) WHERE regexp_matches(en, ' {{2,}}') AND NOT regexp_matches(en, '[\n\r\t]') AND NOT regexp_matches(en, '<[^>]+>') AND NOT regexp_matches(en, '{_TOKEN}') AND NOT {tech('en')}""")
def spacing_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.spacing_findings(rows(spark, sf_dir, PAIRS, costly=True))


def _lost(en: str, ar: str) -> str:
    norm = lambda c: rf"translate(regexp_replace({c}, '[\x{{064B}}-\x{{065F}}\x{{0670}}]', '', 'g'), 'أإآٱة', 'اااا' || 'ه')"
    one = [rf"CASE WHEN regexp_matches(lower({en}), '(^|[^\p{{L}}\p{{N}}_]){v}($|[^\p{{L}}\p{{N}}_])') AND NOT (" + " OR ".join(f"contains({norm(ar)}, {norm(repr(f))})" for f in pr.ACTIONS[v].split()) + f") THEN '{v}' END" for v in sorted(pr.ACTIONS)]
    return f"concat_ws(' ', {', '.join(one)})"


_SHAPES = f"SELECT key, {shape('en')} AS se, {shape('ar')} AS sa, {n_words('en')} AS n, {_lost('en', 'ar')} AS actions FROM ({PAIRS}) WHERE {strip('en')} <> '' AND {strip('ar')} <> ''"


@query(f"""SELECT key, actions, 'sentence_shape_mismatch' AS issue_type FROM ({_SHAPES}) WHERE se = 'sentence_like' AND sa IN ('short_label', 'phrase') UNION ALL
 SELECT key, actions, 'message_label_mismatch' FROM ({_SHAPES}) WHERE se = 'short_label' AND sa = 'sentence_like' UNION ALL
 SELECT key, actions, 'possible_meaning_loss' FROM ({_SHAPES}) WHERE n >= 3 AND actions <> ''""")
def shape_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.shape_findings(rows(spark, sf_dir, PAIRS, costly=True))


def _cues(c: str) -> str:
    return rf"list_distinct(list_concat(['s:' || {shape(c)}], list_transform(regexp_extract_all({c}, '[0-9]+'), lambda x: 'n:' || x), list_transform(regexp_extract_all({c}, '\{{[^{{}}]+\}}'), lambda x: 'p:' || x)))"


@query(f"SELECT key, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) AS similarity FROM (SELECT key, {_cues('en')} AS a, {_cues('ar')} AS b FROM ({PAIRS}) WHERE en IS NOT NULL AND ar IS NOT NULL)")
def cue_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, PAIRS).where("en is not null and ar is not null")
    return d.select("key", F.round(pr.jaccard(pr.cues(F.col("en")), pr.cues(F.col("ar"))), 4).alias("similarity"))


def _set(c: str, rx: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({c}, '{rx}')))"


def _lost_set(rx: str) -> str:
    return f"len(list_filter({_set('en', rx)}, lambda x: NOT list_contains({_set('ar', rx)}, x))) > 0"


_CODES = rf"""concat_ws(' ', CASE WHEN {strip('ar')} = '' THEN 'empty' END, CASE WHEN {_lost_set(r'\{[^{}]+\}|%[sd]')} THEN 'placeholder_loss' END, CASE WHEN {_lost_set('<[^>]+>')} THEN 'tag_loss' END,
 CASE WHEN {_set('en', '[0-9]+')} <> {_set('ar', '[0-9]+')} THEN 'number_change' END, CASE WHEN length(ar) > 3 * length(en) THEN 'expansion' END,
 CASE WHEN length(ar) - length(replace(ar, chr(10), '')) < length(en) - length(replace(en, chr(10), '')) THEN 'line_loss' END)"""


@query(f"SELECT key, codes, CASE WHEN codes LIKE '%empty%' OR codes LIKE '%placeholder_loss%' OR codes LIKE '%tag_loss%' THEN 'reject' WHEN codes <> '' THEN 'suspicious' ELSE 'accept' END AS decision FROM (SELECT key, {_CODES} AS codes FROM ({PAIRS}) WHERE en IS NOT NULL AND ar IS NOT NULL UNION ALL SELECT key, {_CODES} FROM ({TURNS}) WHERE en IS NOT NULL AND ar IS NOT NULL)")
def acceptance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = rows(spark, sf_dir, PAIRS).select("key", "en", "ar").unionAll(rows(spark, sf_dir, TURNS).select("key", "en", "ar"))
    codes = pr.gate_codes(F.col("en"), F.col("ar"))
    return both.where("en is not null and ar is not null").select("key", F.array_join(codes, " ").alias("codes"), pr.gate_decision(codes).alias("decision"))


_WORD = r"regexp_matches(lower(en), '(^|[^\p{L}\p{N}_])' || lower(term_en) || '($|[^\p{L}\p{N}_])')"


@query(f"SELECT key, term_en, approved FROM ({GLOSSED}) s JOIN ({GLOSSARY}) g ON {_WORD}")
def glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gl.term_matches(rows(spark, sf_dir, GLOSSED), rows(spark, sf_dir, GLOSSARY)).select("key", "term_en", "approved")


@query(f"SELECT key, term_en, CASE WHEN contains(lower(ar), forbidden) THEN 'forbidden_term' ELSE 'hard_violation' END AS issue_type FROM ({GLOSSED}) s JOIN ({GLOSSARY}) g ON {_WORD} WHERE contains(lower(ar), lower(forbidden)) OR NOT contains(lower(ar), lower(approved))")
def glossary_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gl.compliance(rows(spark, sf_dir, GLOSSED), rows(spark, sf_dir, GLOSSARY)).select("key", "term_en", "issue_type")


@query(f"SELECT key, arg_min(forbidden, ord) AS forbidden, arg_min(approved, ord) AS approved FROM ({GLOSSED}) s JOIN ({GLOSSARY}) g ON contains(lower(ar), lower(forbidden)) GROUP BY key")
def glossary_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gl.forbidden(rows(spark, sf_dir, GLOSSED), rows(spark, sf_dir, GLOSSARY))


@query(f"SELECT s.key, coalesce(replace(s.ar, g.forbidden, g.approved), s.ar) AS text FROM ({GLOSSED}) s LEFT JOIN ({GLOSSARY}) g ON contains(' ' || s.ar || ' ', ' ' || g.forbidden || ' ')")
def glossary_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gl.replace_terms(rows(spark, sf_dir, GLOSSED), rows(spark, sf_dir, GLOSSARY))
