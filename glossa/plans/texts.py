"""Row-local queries: text shapes, string functions, wording rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import placeholders as ph
from glossa.functions import text as tx
from glossa.plans.adapters import DOCS, PAIRS, rows, table
from glossa.plans.registry import query

_W = r"len(regexp_extract_all({c}, '[A-Za-z\x{{0600}}-\x{{06FF}}0-9]+'))"
_STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_TECH = r"""(regexp_matches({c}, '(?i)https?://\S+|www\.\S+') OR regexp_matches({c}, '(?i)[\w.%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}(\W|$)') OR regexp_matches({c}, '(^|[(\s])~?/[^\s]+')
 OR regexp_matches({c}, '(^|[^A-Za-z0-9_])[A-Za-z]:\\[^\s]+') OR regexp_matches({c}, '(^|[(\s])--\w') OR regexp_matches({c}, '`[^`]+`')
 OR regexp_matches({c}, '(^|\s)(cargo|cat|cd|composer|git|ls|node|npm|npx|pip|pnpm|python|yarn)([^\p{{L}}\p{{N}}_]|$)')
 OR regexp_matches({c}, '(^|[^\p{{L}}\p{{N}}_])([a-z]+[A-Z]|iPhone|iPad|macOS|GitHub)') OR contains({c}, '://') OR contains({c}, '\'))"""


def tech(c: str) -> str:
    return _TECH.format(c=c)


def strip(c: str) -> str:
    return _STRIP.format(c=c)


def n_words(c: str) -> str:
    return _W.format(c=c)


def shape(c: str) -> str:
    s = strip(c)
    return rf"CASE WHEN {c} IS NULL OR {s} = '' THEN 'empty' WHEN {n_words(s)} >= 7 OR contains({s}, chr(10)) OR regexp_matches({s}, '[.!?؟]$') THEN 'sentence_like' WHEN {n_words(s)} BETWEEN 1 AND 3 THEN 'short_label' ELSE 'phrase' END"


@query(rf"SELECT key, regexp_matches(en, '<[^>]+>') AS html, regexp_matches(en, '(?i)\{{[^{{}}]+,\s*(selectordinal|plural|select)\s*,') AS icu, {tech('en')} AS technical, regexp_matches(ar, '[\x{{0600}}-\x{{06FF}}]') AS arabic, ar IS NULL OR {strip('ar')} = '' AS blank, {shape('en')} AS shape FROM ({PAIRS})")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, PAIRS, costly=True)
    return d.select("key", tx.has_html(F.col("en")).alias("html"), tx.has_icu(F.col("en")).alias("icu"), tx.is_technical(F.col("en")).alias("technical"), tx.has_arabic(F.col("ar")).alias("arabic"), tx.is_blank(F.col("ar")).alias("blank"), tx.shape(F.col("en")).alias("shape"))


@query(f"SELECT page_id, {tech('url')} AS technical_url, {tech('html')} AS technical FROM pages")
def technical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.is_technical(F.col("url")).alias("technical_url"), tx.is_technical(F.col("html")).alias("technical"))


@query(rf"SELECT key, {strip('en')} AS stripped, regexp_replace(en, ' {{2,}}', ' ', 'g') AS collapsed, {strip('en')} <> en AS padded FROM ({PAIRS})")
def string_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("en")
    return rows(spark, sf_dir, PAIRS).select("key", tx.strip(c).alias("stripped"), tx.collapse(c).alias("collapsed"), (tx.strip(c) != c).alias("padded"))


_NAME = "concat('screen', replace(p_type, ' ', ''), 'Of', replace(p_brand, '#', '_'))"


@query(rf"SELECT p_partkey, lower(regexp_replace(regexp_replace({_NAME}, '(.)([A-Z][a-z][a-z]*)', '\1_\2', 'g'), '([0-9a-z])([A-Z])', '\1_\2', 'g')) AS snake, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace({_NAME}, '([0-9a-z])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_'), lambda x: x <> ''), ' ') AS tokens FROM part")
def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr(_NAME)
    return table(spark, sf_dir, "part").select("p_partkey", tx.camel_to_snake(n).alias("snake"), F.array_join(tx.key_tokens(n), " ").alias("tokens"))


_CELL = "CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN concat('=', p_name) WHEN 1 THEN concat('-', p_name) WHEN 2 THEN concat('@', p_name) WHEN 3 THEN concat('+', p_name) ELSE p_name END"


@query(rf"SELECT p_partkey, CASE WHEN regexp_matches(v, '^[=+\-@]') THEN chr(39) || v ELSE v END AS cell FROM (SELECT p_partkey, {_CELL} AS v FROM part)")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.csv_guard(F.expr(_CELL)).alias("cell"))


def _wording_sql() -> str:
    word = lambda p: re.escape(p).replace("\\ ", " ").replace("'", "''")
    one = [rf"SELECT key, '{t}' AS issue_type, '{m}' AS message, en AS old, regexp_replace(en, '(?i)(^|[^\p{{L}}\p{{N}}_]){word(p)}($|[^\p{{L}}\p{{N}}_])', '\1{r}\2', 'g') AS new FROM p WHERE regexp_matches(en, '(?i)(^|[^\p{{L}}\p{{N}}_]){word(p)}($|[^\p{{L}}\p{{N}}_])')" for t, p, r, m in tx.WORDING]
    return f"WITH p AS (SELECT key, en FROM ({PAIRS}) WHERE NOT {tech('en')} AND NOT regexp_matches(en, '[<>]')) " + " UNION ALL ".join(one)


@query(_wording_sql())
def wording_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, PAIRS, costly=True).where("en is not null")
    return d.select("key", F.col("en").alias("old"), F.explode(tx.wording_issues(F.col("en"))).alias("x")).select("key", "x.issue_type", "x.message", "old", "x.new")


def _nested_replace() -> str:
    c = "en"
    for wrong in sorted(tx.SAFE_REPLACEMENTS, key=len, reverse=True):
        c = f"replace({c}, '{wrong}', '{tx.SAFE_REPLACEMENTS[wrong].replace(chr(39), chr(39) * 2)}')"
    return c


@query(f"SELECT key, {_nested_replace()} AS text FROM ({PAIRS})")
def safe_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, PAIRS, costly=True).select("key", tx.safe_replace(F.col("en")).alias("text"))


@query(rf"SELECT key, en <> '' AND ar <> '' AND en <> ar AND len(regexp_extract_all(en, '\S+')) <= 12 AND len(regexp_extract_all(ar, '\S+')) <= 12 AND abs(length(en) - length(ar)) <= greatest(10, length(en) // 2) AS small FROM ({PAIRS}) WHERE en IS NOT NULL AND ar IS NOT NULL")
def small_safe_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, PAIRS).where("en is not null and ar is not null")
    return d.select("key", tx.is_small_change(F.col("en"), F.col("ar")).alias("small"))


@query(f"SELECT key, {shape('value')} AS shape, length(value) - length(replace(value, chr(10), '')) AS lines FROM ({DOCS})")
def document_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("value")
    return rows(spark, sf_dir, DOCS).select("key", tx.shape(c).alias("shape"), tx.line_count(c).alias("lines"))


@query(rf"SELECT key, locale FROM ({DOCS}) WHERE regexp_matches(value, '!!|\?\?|,,|::|;;|\.\.|؟؟|،،')")
def repeated_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, DOCS).where(tx.doubled_punctuation(F.col("value"))).select("key", "locale")


@query(f"SELECT key, locale, length(value) AS n FROM ({DOCS}) WHERE length(value) > 120")
def long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, DOCS).where(F.length("value") > 120).select("key", "locale", F.length("value").cast("bigint").alias("n"))


@query(rf"SELECT key, upper(substr(lower(en), 1, 1)) || substr(lower(en), 2) AS new FROM ({PAIRS}) WHERE len(regexp_extract_all(en, '[A-Za-z]+')) >= 4 AND len(list_filter(regexp_extract_all(en, '[A-Za-z]+'), lambda x: NOT regexp_matches(x, '^[A-Z]'))) = 0")
def capitalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, PAIRS).where(tx.is_title_case(F.col("en"))).select("key", tx.sentence_case(F.col("en")).alias("new"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<[^>]+>'))), ' ') AS tags FROM pages")
def html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tx.html_tags(F.col("html")), " ").alias("tags"))


@query(f"SELECT key, sha256(value) AS hash, substr(sha256(key || chr(31) || locale), 1, 16) AS plan_id FROM ({DOCS})")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, DOCS).select("key", tx.text_hash(F.col("value")).alias("hash"), tx.plan_id(F.col("key"), F.col("locale")).alias("plan_id"))


_OLD, _NEW = "p_name", "CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN concat(p_name, '!') WHEN 3 THEN replace(p_name, ' ', '  ') WHEN 4 THEN concat(substr(p_name, 1, length(p_name) - 1), 'zq') ELSE concat('new ', p_name) END"
_PUNCT = r"trim(regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""SELECT p_partkey, CASE WHEN o = n THEN 'equal' WHEN regexp_replace(o, '\s+', '', 'g') = regexp_replace(n, '\s+', '', 'g') THEN 'whitespace' WHEN lower(o) = lower(n) THEN 'case'
 WHEN {_PUNCT.format(c='o')} = {_PUNCT.format(c='n')} THEN 'punctuation'
 WHEN len(string_split(o, ' ')) = len(string_split(n, ' ')) AND len(list_filter(list_zip(string_split(o, ' '), string_split(n, ' ')), lambda x: x[1] <> x[2])) = 1
  AND list_max(list_transform(list_zip(string_split(o, ' '), string_split(n, ' ')), lambda x: levenshtein(x[1], x[2]))) <= 2 THEN 'typo' ELSE 'none' END AS risk, levenshtein(o, n) AS edits
 FROM (SELECT p_partkey, {_OLD} AS o, {_NEW} AS n FROM part)""")
def low_risk_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = F.expr(_OLD), F.expr(_NEW)
    return table(spark, sf_dir, "part").select("p_partkey", tx.low_risk_edit(o, n).alias("risk"), F.levenshtein(o, n).cast("bigint").alias("edits"))


@query(rf"SELECT key, translate(regexp_replace(ar, '[\x{{064B}}-\x{{065F}}\x{{0670}}]', '', 'g'), 'أإآٱة', 'اااا' || 'ه') AS ar, regexp_matches(ar, '[\x{{0600}}-\x{{06FF}}]') AND regexp_matches(ar, '[A-Za-z]') AS mixed FROM ({PAIRS})")
def arabic_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ar")
    return rows(spark, sf_dir, PAIRS).select("key", tx.normalize_arabic(c).alias("ar"), (tx.has_arabic(c) & tx.has_latin(c)).alias("mixed"))


_TOKEN = r"\$\{\w+\}|\{\{\w+\}\}|\{\w+\}|%(?:[0-9]+\$)?[sdfox@]|:[A-Za-z_]\w*|\$[0-9]+"


@query(rf"SELECT key, array_to_string(regexp_extract_all(en, '{_TOKEN}'), ' ') AS en, array_to_string(regexp_extract_all(ar, '{_TOKEN}'), ' ') AS ar FROM (SELECT key, coalesce(en, '') AS en, coalesce(ar, '') AS ar FROM ({PAIRS}))")
def placeholder_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, PAIRS, costly=True)
    raw = lambda c: F.array_join(F.transform(ph.parse(F.col(c)), lambda x: x["raw"]), " ").alias(c)
    return d.select("key", raw("en"), raw("ar"))


@query()
def placeholder_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, PAIRS, costly=True).select("key", ph.parse(F.col("en")).alias("e"), ph.parse(F.col("ar")).alias("a"))
    return d.select("key", F.explode(ph.compare(F.col("e"), F.col("a"))).alias("x")).select("key", "x.issue_type", "x.severity", "x.message")


@query(rf"SELECT key, len(regexp_extract_all(en, '{_TOKEN}')) AS n_en, len(regexp_extract_all(ar, '{_TOKEN}')) AS n_ar FROM (SELECT key, coalesce(en, '') AS en, coalesce(ar, '') AS ar FROM ({PAIRS})) WHERE len(regexp_extract_all(en, '{_TOKEN}')) <> len(regexp_extract_all(ar, '{_TOKEN}'))")
def placeholder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows(spark, sf_dir, PAIRS, costly=True).select("key", F.size(ph.parse(F.col("en"))).cast("bigint").alias("n_en"), F.size(ph.parse(F.col("ar"))).cast("bigint").alias("n_ar"))
    return d.where("n_en <> n_ar")


_ICU_EN = "concat('{count, plural, one {# ', lower(n_name), '} other {# in {place}}}')"
_ICU_AR = "CASE CAST(n_nationkey % 4 AS INT) WHEN 0 THEN concat('{count, plural, one {# ', lower(n_name), '} other {# in {place}}}') WHEN 1 THEN '{count, plural, one {#}}' WHEN 2 THEN 'plain' ELSE '{count, plural, one {# other {x}}' END"


@query("SELECT n_nationkey, CASE CAST(n_nationkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'icu_branch_incomplete icu_branch_mismatch' WHEN 2 THEN 'icu_literal_text_only' ELSE 'icu_syntax_error' END AS issues FROM nation")
def icu_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.functions.icu import issues

    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(issues(F.expr(_ICU_EN), F.expr(_ICU_AR)), " ").alias("issues"))
