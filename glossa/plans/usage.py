"""Queries on key usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import usage as us
from glossa.plans.adapters import LINES, rows
from glossa.plans.registry import query

_RX = {"getx": r"""["'']([A-Za-z0-9_.-]+)["'']\.tr\b""", "function": r"""\bt\(["'']([A-Za-z0-9_.-]+)["'']\)""", "laravel": r"""__\(["'']([A-Za-z0-9_.-]+)["'']\)""", "concat": r"""\bt\(["'']([A-Za-z0-9_.-]+)["''] \+ """}
_PLACE = "CASE WHEN contains(lower(code), 'showdialog') OR contains(lower(code), 'modal') THEN 'dialog' WHEN contains(lower(code), 'button') THEN 'button' WHEN contains(lower(code), 'title') THEN 'title' WHEN contains(lower(code), 'label') THEN 'label' WHEN contains(lower(code), 'text(') THEN 'body' ELSE 'unknown' END"
_USED = " UNION ALL ".join(f"SELECT id, line, '{f}' AS family, '{'dynamic' if f == 'concat' else 'static'}' AS mode, {_PLACE} AS place, unnest(regexp_extract_all(code, '{rx}', 1)) AS key FROM ({LINES})" for f, rx in _RX.items())
_CODE_EN = "SELECT concat('orders.', CAST(o_orderkey AS STRING)) AS key FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT concat('status_', lower(o_orderstatus)) FROM orders"
_CODE_AR = "SELECT concat('orders.', CAST(o_orderkey AS STRING)) AS key FROM orders WHERE o_orderkey % 4 <> 0"


def _used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.scan(rows(spark, sf_dir, LINES)).withColumn("place", us.metadata(F.col("code"))).drop("code")


@query(_USED)
def usage_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _used(spark, sf_dir)


@query(f"SELECT key, count(*) AS n, array_to_string(list_sort(list(DISTINCT family)), ',') AS families, array_to_string(list_sort(list(DISTINCT place)), ',') AS places, max(CASE WHEN mode = 'static' THEN 1.0 ELSE 0.65 END) AS confidence FROM ({_USED}) GROUP BY key")
def usage_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.aggregate(_used(spark, sf_dir))


@query(f"SELECT family, mode, count(*) AS n, count(DISTINCT key) AS keys FROM ({_USED}) GROUP BY family, mode")
def usage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _used(spark, sf_dir).groupBy("family", "mode").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query(f"""WITH u AS (SELECT * FROM ({_USED})), e AS (SELECT DISTINCT key FROM ({_CODE_EN})), a AS (SELECT DISTINCT key FROM ({_CODE_AR})), s AS (SELECT DISTINCT key FROM u WHERE mode <> 'dynamic'),
 p AS (SELECT DISTINCT key AS prefix FROM u WHERE mode = 'dynamic'), k AS (SELECT key FROM e UNION SELECT key FROM a UNION SELECT key FROM s)
 SELECT k.key, CASE WHEN e.key IS NULL AND a.key IS NULL THEN 'missing_in_both' WHEN s.key IS NOT NULL AND a.key IS NULL THEN 'missing_ar' WHEN s.key IS NOT NULL AND e.key IS NULL THEN 'missing_en' WHEN s.key IS NOT NULL THEN 'used'
  WHEN EXISTS (SELECT 1 FROM p WHERE starts_with(k.key, prefix)) THEN 'dynamic' ELSE 'unused' END AS status
 FROM k LEFT JOIN e ON k.key = e.key LEFT JOIN a ON k.key = a.key LEFT JOIN s ON k.key = s.key""")
def key_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.key_status(rows(spark, sf_dir, _CODE_EN), rows(spark, sf_dir, _CODE_AR), _used(spark, sf_dir))


@query(f"SELECT DISTINCT k.key, p.prefix FROM ({_CODE_EN}) k JOIN (SELECT DISTINCT key AS prefix FROM ({_USED}) WHERE mode = 'dynamic') p ON starts_with(k.key, p.prefix)")
def dynamic_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.dynamic_matches(rows(spark, sf_dir, _CODE_EN).distinct(), _used(spark, sf_dir))


@query(f"SELECT DISTINCT key FROM ({_CODE_EN}) WHERE key NOT IN (SELECT key FROM ({_USED}) WHERE key IS NOT NULL)")
def unused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _CODE_EN).distinct().join(_used(spark, sf_dir).select("key"), "key", "left_anti")


@query(f"SELECT DISTINCT key FROM ({_USED}) WHERE key NOT IN (SELECT key FROM ({_CODE_EN})) AND key NOT IN (SELECT key FROM ({_CODE_AR})) AND mode <> 'dynamic'")
def used_missing_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _used(spark, sf_dir).where("mode <> 'dynamic'").select("key").distinct()
    return u.join(rows(spark, sf_dir, _CODE_EN), "key", "left_anti").join(rows(spark, sf_dir, _CODE_AR), "key", "left_anti")


@query(f"SELECT key FROM ({_CODE_EN}) INTERSECT SELECT key FROM ({_CODE_AR})")
def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _CODE_EN).intersect(rows(spark, sf_dir, _CODE_AR))


@query(f"SELECT key FROM ({_CODE_EN}) UNION SELECT key FROM ({_CODE_AR}) UNION SELECT key FROM ({_USED})")
def all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, _CODE_EN).union(rows(spark, sf_dir, _CODE_AR)).union(_used(spark, sf_dir).select("key")).distinct()


#: One line of code for each pattern, in several frameworks. The dollar and the brace are apart, as Spark's SQL would take them for a variable.
CODE = """SELECT p_partkey AS id, CASE CAST(p_partkey % 27 AS INT)
  WHEN 0 THEN concat('ElevatedButton(child: Text("home.', CAST(p_size AS STRING), '".tr))')
  WHEN 1 THEN 'final s = labels.save.tr;'
  WHEN 2 THEN concat('tr("k.', CAST(p_size AS STRING), '") + tr(name)')
  WHEN 3 THEN 'AlertDialog(title: translate("dlg.title"))'
  WHEN 4 THEN 'showDialog(translate(key, 2))'
  WHEN 5 THEN 'getTranslated("user.name")'
  WHEN 6 THEN 'SnackBar(lang.translate("done.saved"))'
  WHEN 7 THEN 'lang.translate(code)'
  WHEN 8 THEN 'translate(key: "orders.paid")'
  WHEN 9 THEN 'translate(key: $status)'
  WHEN 10 THEN concat('{{ __("auth.', CAST(p_size AS STRING), '") }}')
  WHEN 11 THEN '{{ __($message) }}'
  WHEN 12 THEN '@lang("site.title") @lang($other)'
  WHEN 13 THEN 'trans("mail.body"); trans($view)'
  WHEN 14 THEN '<p>{t("nav.home")}</p> <b>{t(label)}</b>'
  WHEN 15 THEN 'i18n.t("a.b") + i18n.t(x)'
  WHEN 16 THEN '{{ $t("vue.key") }} {{ $t(item) }}'
  WHEN 17 THEN concat('"status_$', '{state}".tr')
  WHEN 18 THEN '"error_" + code'
  WHEN 19 THEN 'prefix + "_title"'
  WHEN 20 THEN '"a_" + kind + "_z"'
  WHEN 21 THEN 'TextField(hintText: t("form.name"))'
  WHEN 22 THEN 'TextFormField(labelText: t("form.mail"))'
  WHEN 23 THEN 'AppBar(title: t("screen.main"))'
  WHEN 24 THEN 'push(notification_title: t("push.t"), failed: true)'
  WHEN 25 THEN 'showModal(t("modal.text"), onPress: submit)'
  ELSE concat('int n = ', CAST(p_size AS STRING), ';') END AS code FROM part"""


def _builtin_sql() -> str:
    out = []
    for family, mode, rx in us.BUILTIN:
        plain = rx.replace(r"(?<![\w.$])", r"(?:^|[^\w.$])").replace(us._ARG, r"""([^'"\s)][^)\r\n]*?)\s*[,)]""").replace("'", "''")
        found = f"regexp_extract_all(code, '{plain}', 1)"
        if us._KEY in rx:
            found = f"list_transform(list_zip({found}, regexp_extract_all(code, '{plain}', 2)), lambda x: coalesce(nullif(x[1], ''), x[2]))"
        out.append(f"SELECT id, '{family}' AS family, '{mode}' AS mode, unnest({found}) AS key FROM ({CODE})")
    return " UNION ALL ".join(out)


@query(_builtin_sql())
def usage_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.scan(rows(spark, sf_dir, CODE), patterns=us.BUILTIN).drop("code")


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(c, '{w}')" for w in words) + ")"


_LOCATION = f"""CASE WHEN {_has('snackbar', 'flushbar', 'scaffoldmessenger')} THEN 'snackbar' WHEN {_has('toast')} THEN 'toast' WHEN {_has('notification_title')} THEN 'notification_title' WHEN {_has('notification_body', 'pushbody')} THEN 'notification_body'
 WHEN {_has('subtitle')} THEN 'subtitle' WHEN {_has('helper')} THEN 'helper_text' WHEN {_has('hinttext', 'placeholder')} THEN 'form_hint' WHEN {_has('labeltext', 'formfield', 'textfield')} THEN 'form_label'
 WHEN {_has('alertdialog')} AND {_has('title')} THEN 'dialog_title' WHEN {_has('dialog', 'modal')} THEN 'dialog_body' WHEN {_has('appbar', 'title:', 'screen_title')} THEN 'title' WHEN {_has('elevatedbutton', 'textbutton', 'outlinedbutton', 'iconbutton', 'button(')} THEN 'button' ELSE 'unknown' END"""


@query(f"""WITH l AS (SELECT id, c, {_LOCATION} AS location FROM (SELECT id, lower(code) AS c FROM ({CODE})))
 SELECT id, location, CASE WHEN location IN ('dialog_title', 'dialog_body') THEN 'dialog' WHEN location IN ('notification_title', 'notification_body') THEN 'notification' WHEN location IN ('snackbar', 'toast') THEN 'feedback' WHEN location IN ('form_label', 'form_hint', 'helper_text') THEN 'form' WHEN location IN ('title', 'subtitle') THEN 'screen' WHEN location = 'button' THEN 'action' ELSE 'generic' END AS surface,
 CASE WHEN location IN ('button', 'form_label', 'title', 'dialog_title', 'notification_title') THEN 'label' WHEN location IN ('form_hint', 'helper_text', 'subtitle', 'dialog_body', 'notification_body', 'snackbar', 'toast') THEN 'message' ELSE 'body' END AS role,
 CASE WHEN regexp_matches(c, 'save|submit|continue|next|retry|confirm|approve|send|delete|add|create|tap|click|press') THEN 'action' WHEN regexp_matches(c, 'error|failed|warning|invalid|required|success|done') THEN 'status' ELSE 'inform' END AS action, CASE WHEN contains(c, 'user') THEN 'role_specific' ELSE 'general' END AS audience FROM l""")
def usage_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, CODE).select("id", us.attributes(F.col("code"), ("user",)).alias("x")).select("id", "x.*")


@query(f"SELECT u.id, u.key FROM ({_builtin_sql()}) u WHERE u.mode = 'static' AND u.key IN (SELECT concat('k.', CAST(p_size AS STRING)) FROM part WHERE p_size < 20)")
def usage_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = rows(spark, sf_dir, "SELECT concat('k.', CAST(p_size AS STRING)) AS key FROM part WHERE p_size < 20")
    return us.scan(rows(spark, sf_dir, CODE), patterns=us.BUILTIN).where("mode = 'static'").join(wanted, "key", "left_semi").select("id", "key")
