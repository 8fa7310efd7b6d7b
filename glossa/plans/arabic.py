"""Queries of the Arabic rules, and their SQL. RE2 has no lookaround and no back references, so the SQL spells these out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import arabic as ar
from glossa.plans.adapters import rows
from glossa.plans.registry import query
from glossa.plans.texts import strip, tech

#: key, en and ar, each kind of trouble once in 24 rows.
TEXTS = """SELECT p_partkey AS id, concat('ar.', CAST(p_partkey AS STRING)) AS key, concat('Please save the file for ', p_name, ' now.') AS en, CASE CAST(p_partkey % 24 AS INT)
  WHEN 0 THEN concat(' احفظ الملف رقم ', CAST(p_size AS STRING), ' ')
  WHEN 1 THEN concat('اسم  {name} رقم ', CAST(p_size AS STRING), ' ؟')
  WHEN 2 THEN 'السعر ( {amount} ) دولار'
  WHEN 3 THEN concat('نعم / لا رقم ', CAST(p_size AS STRING))
  WHEN 4 THEN 'هل تريد, {name}?'
  WHEN 5 THEN 'اختر، ثم, اضغط; هنا'
  WHEN 6 THEN concat('توقف!! الآن ', CAST(p_size AS STRING))
  WHEN 7 THEN 'ابدأ الآن!'
  WHEN 8 THEN p_name
  WHEN 9 THEN concat('طلب ', p_brand, ' من ', p_name)
  WHEN 10 THEN 'رمز OTP عبر SMS من Google'
  WHEN 11 THEN 'لحظة من فضلك يرجى الانتظار'
  WHEN 12 THEN 'قم  بالضغط هنا للمتابعة'
  WHEN 13 THEN 'TODO'
  WHEN 14 THEN '---'
  WHEN 15 THEN ''
  WHEN 16 THEN concat('نص طويل ', repeat('كلمة ', p_size))
  WHEN 17 THEN 'السعر 1,500 دولار، شامل؟؟'
  WHEN 18 THEN 'زوروا https://example.org اليوم?'
  WHEN 19 THEN '{count} عناصر  :id ( %s )  جديد'
  WHEN 20 THEN 'مرحبا    <b>بك</b>'
  WHEN 21 THEN '  '
  WHEN 22 THEN concat('تم حفظ الملف  بنجاح ', CAST(p_size AS STRING))
  ELSE concat('أرسل  الطلب ', CAST(p_size AS STRING), ' الآن') END AS ar FROM part"""

_TOKEN = r"\$\{\w+\}|\{\{\w+\}\}|\{\w+\}|%(?:[0-9]+\$)?[sdfox@]|\$[0-9]+|:[A-Za-z_]\w*"
_MARK = "chr(57344)"
_ARABIC = r"regexp_matches({c}, '[\x{{0600}}-\x{{06FF}}]')"


def _masked(where: str = "true") -> str:
    """Masked texts m, their placeholders f and the raw text, once each."""
    return f"(SELECT id, key, en, ar, regexp_replace(ar, '{_TOKEN}', {_MARK}, 'g') AS m, regexp_extract_all(ar, '{_TOKEN}') AS f FROM ({TEXTS})) WHERE {where}"


def _back(c: str) -> str:
    return f"array_to_string(list_transform(range(1, len(string_split({c}, {_MARK})) + 1), lambda i: string_split({c}, {_MARK})[i] || coalesce(f[i], '')), '')"


def _sql(where: str, kind: str, severity: str, new: str = "''", related: str = "''", fix: str = "review_required") -> str:
    return f"SELECT key, '{kind}' AS issue_type, '{severity}' AS severity, ar AS old, {new} AS new, {related} AS related, '{fix}' AS fix_mode FROM {_masked(where)}"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, TEXTS, costly=True)


def _run(spark: SparkSession, sf_dir: str, *rules) -> DataFrame:
    """Findings of single rules; each takes the columns key and ar."""
    d = _texts(spark, sf_dir).select("key", F.col("ar").alias("old"), F.explode(F.flatten(F.array(*[r(F.col("key"), F.col("ar")) for r in rules]))).alias("x"))
    return d.select("key", "x.issue_type", "x.severity", "old", "x.new", "x.related", "x.fix_mode")


_RISKY = rf"(regexp_matches(ar, '[\n\r\t]') OR regexp_matches(ar, '<[^>]+>') OR len(f) > 0 OR {tech('ar')})"
_PUNCT = rf"NOT {tech('ar')} AND NOT regexp_matches(ar, '<[^>]+>')"
_COMMA = r"regexp_replace(m, '(^|[^0-9]),([^0-9]|$)', '\1،\2', 'g')"
_SWAPPED = f"translate({_COMMA}, ';?', '؛؟')"
_SWAPS = f"array_to_string(list_filter([CASE WHEN {_COMMA} <> m THEN ', -> ،' END, CASE WHEN contains(m, ';') THEN '; -> ؛' END, CASE WHEN contains(m, '?') THEN '? -> ؟' END], lambda x: x IS NOT NULL), ', ')"
_PAIR = r"CASE WHEN contains(m, ',') AND contains(m, '،') AND NOT regexp_matches(m, '[0-9],[0-9]') THEN ', and ،' WHEN contains(m, ';') AND contains(m, '؛') THEN '; and ؛' WHEN contains(m, '?') AND contains(m, '؟') THEN '? and ؟' END"
_AGAIN = r"!!+|؟؟+|\?\?+|,,+|،،+|؛؛+|::+"
_ONCE = "m"
for _p in ("!", "؟", r"\?", ",", "،", "؛", ":"):
    _ONCE = f"regexp_replace({_ONCE}, '{_p}{_p}+', '{_p[-1]}', 'g')"
_SHORT = f"(contains({strip('m')}, '!') AND length({strip('m')}) + 7 * len(f) <= 12 AND regexp_matches({strip('m')}, '{'|'.join(ar.EXCLAMATIONS)}'))"
_KNOWN = "[" + ", ".join(f"'{w}'" for w in ar.LATIN_ALLOWED) + "]"
_PLAIN = rf"replace(regexp_replace(m, '(?i)(https?://|www\.|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', '', 'g'), {_MARK}, ' ')"
_WORDS = rf"list_filter(regexp_extract_all({_PLAIN}, '\b[A-Za-z][A-Za-z0-9._+-]*\b'), lambda w: NOT list_contains({_KNOWN}, lower(w)) AND NOT regexp_matches(w, '^[A-Z]{{2,4}}$'))"
_LATIN = f"{strip('ar')} <> '' AND len({_WORDS}) > 0"
_COMPARED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(ar), '\s+', ' ', 'g'), '\s+([،؛؟:!])', '\1', 'g'), '([(\[{])\s+', '\1', 'g'), '\s+([)\]}])', '\1', 'g'), '\s*/\s*', '/', 'g')"
_STAND_IN = f"regexp_matches({strip('ar')}, '(?i)^(todo|tbd|xxx+|lorem ipsum|placeholder|translation|test)$')"

_RULES = {
    "ar_whitespace": (lambda k, c: _only(ar.spacing(c), "whitespace"), _sql(f"{strip('m')} <> m", "whitespace", "low", _back(strip("m")), fix="auto_safe")),
    "ar_spacing": (lambda k, c: _only(ar.spacing(c), "spacing"), _sql(f"contains(m, '  ') AND NOT {_RISKY}", "spacing", "low", _back("regexp_replace(m, ' {2,}', ' ', 'g')"), fix="auto_safe")),
    "ar_punctuation_spacing": (lambda k, c: _only(ar.spacing(c), "punctuation_spacing"), _sql(r"regexp_matches(m, '\s+[،؛؟:!]')", "punctuation_spacing", "low", _back(r"regexp_replace(m, '\s+([،؛؟:!])', '\1', 'g')"), fix="auto_safe")),
    "ar_bracket_spacing": (lambda k, c: _only(ar.spacing(c), "bracket_spacing"), _sql(r"regexp_matches(m, '[(\[{]\s+|\s+[)\]}]')", "bracket_spacing", "low", _back(r"regexp_replace(regexp_replace(m, '([(\[{])\s+', '\1', 'g'), '\s+([)\]}])', '\1', 'g')"), fix="auto_safe")),
    "ar_slash_spacing": (lambda k, c: _only(ar.spacing(c), "slash_spacing"), _sql("contains(m, ' / ')", "slash_spacing", "low", _back(r"regexp_replace(m, '\s*/\s*', '/', 'g')"), fix="auto_safe")),
    "ar_english_punctuation": (lambda k, c: _only(ar.punctuation(c), "english_punctuation"), _sql(f"{_PUNCT} AND {_ARABIC.format(c='m')} AND {_SWAPPED} <> m", "english_punctuation", "low", _back(_SWAPPED), _SWAPS, "auto_safe")),
    "ar_mixed_punctuation": (lambda k, c: _only(ar.punctuation(c), "mixed_punctuation"), _sql(f"{_PUNCT} AND {_PAIR} IS NOT NULL", "mixed_punctuation", "medium", related=_PAIR)),
    "ar_repeated_punctuation": (lambda k, c: _only(ar.punctuation(c), "repeated_punctuation"), _sql(f"{_PUNCT} AND regexp_matches(m, '{_AGAIN}')", "repeated_punctuation", "medium", _back(_ONCE))),
    "ar_exclamation_style": (lambda k, c: _only(ar.punctuation(c), "exclamation_style"), _sql(f"{_PUNCT} AND (contains(m, '!!') OR {_SHORT})", "exclamation_style", "info")),
    "ar_untranslated": (lambda k, c: _only(ar.scripts(k, c), "untranslated_english"), _sql(f"{_LATIN} AND NOT {_ARABIC.format(c='ar')}", "untranslated_english", "high")),
    "ar_mixed_script": (lambda k, c: _only(ar.scripts(k, c), "mixed_script"), _sql(f"{_LATIN} AND {_ARABIC.format(c='ar')}", "mixed_script", "medium", related=f"array_to_string(list_sort(list_distinct({_WORDS}))[1:8], ', ')")),
    "ar_literal_translation": (lambda k, c: ar.literal(c), " UNION ALL ".join(_sql(f"{_ARABIC.format(c='ar')} AND contains({_COMPARED}, '{p}') AND regexp_matches({_COMPARED}, '{'|'.join(ws)}')", "suspicious_literal_translation", "info", related=f"'{p}'") for p, ws in ar.LITERAL)),
    "ar_weak_text": (lambda k, c: ar.weak(c), " UNION ALL ".join((_sql(f"{strip('ar')} = ''", "empty_string", "high"), _sql(_STAND_IN, "placeholder_text", "high"), _sql(rf"NOT {_STAND_IN} AND regexp_matches({strip('ar')}, '^[^\p{{L}}\p{{N}}]+$')", "weak_text", "medium")))),
    "ar_long_text": (lambda k, c: ar.long(c), _sql(f"length({strip('ar')}) > {ar.LONG}", "long_ui_string", "info", related=f"CAST(length({strip('ar')}) AS VARCHAR) || ' chars'")),
}


def _only(issues, kind: str):
    return F.filter(issues, lambda x: x["issue_type"] == kind)


def _register(name: str, rule, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _run(spark, sf_dir, rule)

    run.__name__ = name
    query(sql, name)(run)


for _name, (_rule, _text) in _RULES.items():
    _register(_name, _rule, _text)


@query(" UNION ALL ".join(f"({sql})" for _, sql in _RULES.values()))
def ar_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ar.findings(_texts(spark, sf_dir))


@query(f"SELECT key, m AS masked, array_to_string(f, ' ') AS marks, {_back('m')} AS back, {_back('m')} = ar AS same FROM {_masked()}")
def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ar")
    back = ar.unmask(ar.mask(c), ar.tokens(c))
    return _texts(spark, sf_dir).select("key", ar.mask(c).alias("masked"), F.array_join(ar.tokens(c), " ").alias("marks"), back.alias("back"), (back == c).alias("same"))


_STOP = "[" + ", ".join(f"'{w}'" for w in ar.STOPWORDS) + "]"
_AR_WORDS = r"regexp_extract_all(ar, '[\x{0600}-\x{06FF}]+')"


@query(rf"SELECT key, coalesce(list_filter({_AR_WORDS}, lambda w: NOT list_contains({_STOP}, w))[1], {_AR_WORDS}[1], '') AS word, substr(trim(regexp_replace(translate(regexp_replace(ar, '[\x{{064B}}-\x{{065F}}\x{{0670}}\x{{0640}}]', '', 'g'), 'أإآٱةى٠١٢٣٤٥٦٧٨٩', 'ااااهي0123456789'), '\s+', ' ', 'g')), 1, 120) AS preview, regexp_matches(ar, 'تم\s|بنجاح|فشل|خطأ([^\p{{L}}]|$)|لا\s+يمكن|غير\s+متاح') AS status FROM ({TEXTS})")
def ar_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("ar")
    return _texts(spark, sf_dir).select("key", ar.first_word(c).alias("word"), ar.preview(c).alias("preview"), ar.is_status(c).alias("status"))


_TERMS = "(VALUES ('الملفات'), ('طلب'), ('كلم'), ('السعر'), ('ل'), ('بالملف'), ('')) AS t(term)"
_CORE = "regexp_replace(regexp_replace({c}, '^(ال|ل|ب|ك|و|ف)', ''), '[اويية]', '', 'g')"


@query(rf"SELECT key, term FROM ({TEXTS}), {_TERMS} WHERE term <> '' AND ar <> '' AND (contains(ar, term) OR (length({_CORE.format(c='term')}) >= 2 AND len(list_filter(regexp_split_to_array(ar, '[^\p{{L}}\p{{N}}_\x{{0600}}-\x{{06FF}}]+'), lambda w: w <> '' AND contains({_CORE.format(c='w')}, {_CORE.format(c='term')}) AND abs(length({_CORE.format(c='w')}) - length({_CORE.format(c='term')})) <= 3)) > 0))")
def ar_fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.explode(F.array(*map(F.lit, ("الملفات", "طلب", "كلم", "السعر", "ل", "بالملف", ""))))  # a stated, fixed list
    d = _texts(spark, sf_dir).select("key", "ar", terms.alias("term"))
    return d.where(ar.fuzzy_contains(F.col("ar"), F.col("term"))).select("key", "term")


_PLAIN_AR = r"translate(regexp_replace(ar, '[\x{064B}-\x{065F}\x{0670}]', '', 'g'), 'أإآٱة', 'اااا' || 'ه')"


@query(rf"SELECT key, CASE WHEN NOT contains({_PLAIN_AR}, 'احفظ') AND NOT contains({_PLAIN_AR}, 'حفظ') AND NOT contains(ar, 'احفظ') AND NOT regexp_matches(ar, 'تم\s|بنجاح|فشل|خطأ([^\p{{L}}]|$)|لا\s+يمكن|غير\s+متاح') THEN trim('احفظ ' || {strip('ar')}) || CASE WHEN regexp_matches({strip('ar')}, '[.!?؟…]$') THEN '' ELSE '.' END ELSE '' END AS candidate FROM ({TEXTS}) WHERE {strip('ar')} <> ''")
def ar_semantic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glossa.functions import text as tx
    from glossa.operators.pairs import ACTIONS, missing_actions

    e, c = F.col("en"), F.col("ar")
    return _texts(spark, sf_dir).where(~tx.is_blank(c)).select("key", ar.candidate(e, c, missing_actions(e, c), ACTIONS).alias("candidate"))
