"""Functions, operators, sources and sinks on small cases; queries against their SQL on the smallest tables."""

from __future__ import annotations

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from glossa import schema as sc
from glossa.functions import icu, placeholders as ph
from glossa.functions import text as tx
from glossa.operators import decision as de
from glossa.operators import findings as fi
from glossa.operators import glossary as gl
from glossa.operators import pairs as pr
from glossa.operators import review as rv
from glossa.operators import usage as us
from glossa.sources import catalogs as ca
from glossa.sources import sinks as si

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return d.select(column.alias("x")).first().x


def test_placeholder_tokens():
    raw = [t[0] for t in ph.tokens("{user} has {0}, ${value}; {{username}}: $1 or %1$s, %@")]
    assert raw == ["{user}", "{0}", "${value}", "{{username}}", "$1", "%1$s", "%@"]
    assert [t[0] for t in ph.tokens("see https://x.org:80/a a:b :id mailto:joe")] == [":id"]
    assert [t[0] for t in ph.tokens("{n, plural, other {# of {m}}}")] == ["#", "{m}"]


@pytest.mark.parametrize(
    ("en", "ar", "kinds"),
    [
        ("Hi {name} {count}", "مرحبا {name} {count}", []),
        ("{count} trips", "رحلات", ["missing_in_ar", "count_mismatch"]),
        ("{count} x", "{total} x", ["renamed_placeholder"]),
        ("{a} {b}", "{b} {a}", ["order_mismatch"]),
        ("{a}", "{{a}}", ["format_mismatch", "mixed_placeholder_style"]),
        ("x", "{a}", ["missing_in_en", "count_mismatch"]),
        (None, "", []),
    ],
)
def test_placeholder_comparison(spark, en, ar, kinds):
    d = spark.createDataFrame([(en, ar)], "e string, a string").select(ph.parse(F.col("e")).alias("e"), ph.parse(F.col("a")).alias("a"))
    assert [x.issue_type for x in d.select(ph.compare(F.col("e"), F.col("a")).alias("x")).first().x] == kinds


def test_icu():
    ok = "{n, plural, =0 {none} one {# item} other {# items of {who}}}"
    assert icu.compare(ok, ok) == [] and icu.compare("plain", "text") == []
    assert icu.compare(ok, "نص") == ["icu_literal_text_only"]
    assert "icu_branch_incomplete" in icu.compare(ok, "{n, plural, one {# x}}")
    assert icu.compare(ok, ok.replace("{who}", "")) == ["icu_placeholder_mismatch"]
    assert icu.compare(ok, "{n, plural, one {# x") == ["icu_syntax_error"]
    nested = "{g, select, f {{n, plural, one {a} other {b}}} other {c}}"
    assert [n["path"] for n in icu.parse(nested)[0]] == ["/g", "/g:f/n"]


def test_text(spark):
    assert one(spark, tx.strip(F.col("a")), a="  x y\t ") == "x y"
    assert one(spark, tx.camel_to_snake(F.col("a")), a="homeTitleHTML") == "home_title_html"
    assert one(spark, tx.csv_guard(F.col("a")), a="=1+1") == "'=1+1"
    assert one(spark, tx.shape(F.col("a")), a="Save your profile to continue.") == "sentence_like"
    assert one(spark, tx.safe_replace(F.col("a")), a="you can not rate 2hours everyday") == "you cannot rate 2 hours every day"
    assert one(spark, tx.is_technical(F.col("a")), a="mail me at a.b@c.org") and not one(spark, tx.is_technical(F.col("a")), a="plain words")
    assert one(spark, tx.low_risk_edit(F.col("a"), F.col("b")), a="Hello wrold", b="Hello world") == "typo"
    for c in (tx.shape(F.col("a")), tx.strip(F.col("a")), tx.safe_replace(F.col("a"))):
        one(spark, c, a=None)


def test_actions(spark):
    flags = lambda e, a: one(spark, F.array_join(pr.missing_actions(F.col("e"), F.col("a")), " "), e=e, a=a)
    assert flags("The guests were entertained", "x") == "" and flags("center it", "x") == ""
    assert flags("Please enter", "x") == "enter"
    assert flags("Do save it", "احْفَظ عملك") == ""


def test_glossary(spark):
    t = spark.createDataFrame([("k", "زبون هنا"), ("l", "زبونا"), ("m", "زبون!")], "key string, ar string")
    g = spark.createDataFrame([(1, "customer", "عميل", "زبون")], "ord int, term_en string, approved string, forbidden string")
    assert {r.key: r.text for r in gl.replace_terms(t, g).collect()} == {"k": "عميل هنا", "l": "زبونا", "m": "عميل!"}
    assert {r.key for r in gl.forbidden(t, g).collect()} == {"k", "l", "m"}


def test_spans(spark):
    rows = [(1, "k", 0, 5, 1), (2, "k", 10, 5, 1), (3, "k", 3, 4, 1), (4, "k", 12, 9, 2), (5, "j", 0, 1, 0)]
    d = spark.createDataFrame(rows, "seq bigint, key string, start int, length int, priority int")
    assert sorted((r.key, r.seq) for r in fi.resolve_spans(d).collect()) == [("j", 5), ("k", 1), ("k", 4)]


def test_decisions(spark):
    cols = "id int, simple boolean, suggestion string, category string, semantic string, placeholder string, glossary string, structure string"
    rows = [(1, True, "x", "grammar", "", "", "", ""), (2, True, "", "grammar", "", "", "", ""), (3, False, "", "other", "", "", "", ""), (4, True, "x", "grammar", "medium", "", "", ""), (5, True, "x", "grammar", "high", None, None, None)]
    got = {r.id: (r.confidence, r.risk, r.route) for r in de.decide(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: (1.0, "low", "auto_fix"), 2: (0.6, "high", "ai_review"), 3: (0.1, "high", "manual_review"), 4: (0.85, "medium", "auto_fix"), 5: (0.7, "high", "ai_review")}


def test_calibration(spark):
    m = spark.createDataFrame([("auto_fix", 0.2)], "route string, rejection_rate double")
    assert tuple(de.calibration(m).first()) == ("auto_fix", 0.85, 0.05)


def test_resolver(spark):
    cat = spark.createDataFrame([("a.b.c",), ("x.b.c",), ("a.d",), ("e",)], "key string")
    ask = spark.createDataFrame([("a.d",), ("d",), ("b.c",), ("zz",), ("",), ("e",)], "key string")
    got = {r.key: (r.status, r.found) for r in rv.resolve_suffixes(ask, cat).collect()}
    assert got == {"a.d": ("direct", "a.d"), "d": ("suffix", "a.d"), "b.c": ("ambiguous", None), "zz": ("missing", None), "": ("empty", None), "e": ("direct", "e")}


def test_usage(spark, tmp_path):
    (tmp_path / "a.dart").write_text("x\nText('home.title'.tr); t(\"ride_started\")\nl10n.signupButton", encoding="utf-8")
    (tmp_path / "b.md").write_text("t('no')")
    used = us.scan(ca.read_code(spark, str(tmp_path), (".dart", ".php")))
    assert sorted((r.line, r.key) for r in used.collect()) == [(2, "home.title"), (2, "ride_started"), (3, "signupButton")]
    catalog = spark.createDataFrame([("signup_button",)], "key string")
    assert "signup_button" in {r.key for r in us.normalize_keys(used, catalog).collect()}


def test_json_catalog(spark, tmp_path):
    (tmp_path / "en.json").write_text(json.dumps({"home": {"title": "T", "cta": {"save": "S"}}, "feature.enabled": True, "count": 3}))
    e = ca.read_catalog(spark, str(tmp_path), "en")
    assert [(r.key, r.value, r.value_type) for r in e.orderBy("ord").collect()] == [("home.title", "T", "string"), ("home.cta.save", "S", "string"), ("feature.enabled", "true", "bool"), ("count", "3", "number")]
    doc = si.catalog_json(e).first().document
    assert json.loads(doc) == {"home.title": "T", "home.cta.save": "S", "feature.enabled": "true", "count": "3"}
    assert ca.collisions(e.union(e.limit(1))).count() == 1
    for bad in ({"a": {"b": 1}, "a.b": 2}, {"a": 1, "a.b": 2}, []):
        with pytest.raises(ca.CatalogError):
            ca.flatten(bad)


def test_php_catalog(spark, tmp_path):
    (tmp_path / "messages.php").write_text("<?php\n// note\nreturn [ 'auth' => array('failed' => 'It\\'s :attribute', \"two\"), # x\n '* odd' => \"a\\nb\", ];")
    e = ca.read_catalog(spark, str(tmp_path), "en", "php")
    got = {r.key: r.value for r in e.collect()}
    assert got == {"messages.auth.failed": "It's :attribute", "messages.auth.0": "two", "messages.* odd": "a\nb"}
    doc = si.catalog_php(e).first().document
    again = ca.flatten(ca.php_array(doc), "messages")
    assert dict(again) == got
    for bad in ("<?php return ['a' => 'b' . 'c'];", "<?php $x = 1;", '<?php return ["a $b"];'):
        with pytest.raises(ca.CatalogError):
            ca.php_array(bad)


def test_xlsx(spark, tmp_path):
    rows = [["k1", "a & b", ""], ["k2", "ü <x>", "z"]]
    (tmp_path / "q.xlsx").write_bytes(si.xlsx_bytes(["key", "old", "new"], rows))
    assert [list(r) for r in ca.read_xlsx(spark, str(tmp_path), ["key", "old", "new"]).collect()] == rows
    assert [ca.column_index(ca.column_name(i)) for i in range(800)] == list(range(800))


def test_csv(spark, tmp_path):
    si.write_csv(spark.createDataFrame([("=x", 1)], "a string, b int"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().a == "'=x"


def test_glossary_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"rules": {"forbidden_terms": [dict(use_instead="b", forbidden_ar="a")]}, "terms": [{"x": 1}, dict(forbidden_ar=["شوفير"], approved_ar="سائق", term_en="Driver")]}))
    terms, rules = ca.read_glossary(spark, str(tmp_path / "g.json"))
    assert terms.count() == 1 and rules.first().use_instead == "b"


def test_severity(spark):
    d = spark.createDataFrame([("critical",), ("info",), ("odd",), (None,)], "s string")
    assert [r[0] for r in d.select(sc.severity_rank(F.col("s"))).collect()] == [0, 4, 99, 99]
    assert one(spark, sc.normalize_severity(F.col("s")), s=" Warning ") == "medium"


def test_stream(spark, tmp_path):
    from glossa.streaming.feedback import windowed

    rows = [("2024-01-01 00:10:00", "auto_fix", True), ("2024-01-01 00:20:00", "", False), ("2024-01-01 05:00:00", "auto_fix", True)]
    d = spark.createDataFrame(rows, "ts string, route string, accepted boolean").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName("fb").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in windowed(d, "1 hour").collect()}
    got = {tuple(r) for r in spark.table("fb").collect()}
    assert got and got <= batch


def _norm(v):
    return "" if v is None else f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    import __spark_entry__ as e
    from glossa.plans import registry

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    assert e.entry(spark).count() > 0
    q = registry.queries()
    for name, sql in registry.oracle_sql().items():
        got = q[name](spark, SF)
        r = con.execute(sql)
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(got.columns), name
        a = sorted(tuple(_norm(row[c]) for c in names) for row in got.collect())
        assert a == sorted(tuple(map(_norm, row)) for row in r.fetchall()), name
    assert math.isfinite(len(q))


def test_reports(spark):
    from glossa.operators import reports as rp

    assert rp.repair_json('```json\n{"a": [1, 2\n```') == {"a": [1, 2]} and rp.repair_json('x {"a": "b"} y') == {"a": "b"} and rp.repair_json("no") is None
    assert one(spark, rp.distinct_notes(F.col("a")), a="x | y | x |  | z") == "x | y | z"
    d = spark.createDataFrame([("k", "Api URL", "grammar", "low", "locale_qc"), ("a_btn", "x", "capitalization", "low", "locale_qc"), ("k2", "x", "style", "info", "ai_review"), ("k3", None, "style", "info", "locale_qc")], "key string, old string, issue_type string, severity string, source string")
    assert [r.key for r in rp.suppress_noise(d).collect()] == ["k2"]


def test_queue(spark):
    from glossa.operators import queue as qu

    d = lambda a, b: one(spark, qu.resolve_candidate(F.col("a"), F.col("b")), a=a, b=b).decision
    assert d("API key", "Api key") == "veto" and d("PayTabs", "Pay Tabs") == "veto"
    assert d("Submit your form", "Send your document") == "suggested_fix" and d("Hello  world", "Hello world") == "suggested_fix"
    assert d("<b>x</b>", "x") == "conflict" and d("x", "") == "none" and d("x", "x more") == "veto"


class Flaky:
    def __init__(self):
        self.calls = 0

    def review(self, items):
        self.calls += 1
        if self.calls == 1:
            raise TimeoutError
        return [{"key": x["key"], "suggestion": "ok"} for x in items if x["key"] != "never"]


class Broken:
    def review(self, items):
        raise ConnectionError


def test_provider(spark):
    from glossa.operators import provider as pv

    d = spark.createDataFrame([("a", "x"), ("never", "y")], "key string, source string").coalesce(1)
    assert {tuple(r) for r in pv.review(d, Flaky()).collect()} == {("a", "ok", None), ("never", None, "no_answer")}
    assert {r.error for r in pv.review(d, Broken(), size=1).collect()} == {"circuit_open"}
    assert {r.suggestion for r in pv.review(d, pv.Mock()).collect()} == {"[x]", "[y]"}


def test_audit(spark, tmp_path):
    from glossa.plans.audit import run_audit

    en = {"home": {"title": "Hello {name}", "x": "Contact with us", "same": "Same"}, "only": "Only here", "gone": "text"}
    ar = {"home": {"title": "مرحبا", "x": "اتصل", "same": "Same"}, "gone": " "}
    (tmp_path / "en.json").write_text(json.dumps(en))
    (tmp_path / "ar.json").write_text(json.dumps(ar))
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.dart").write_text("'home.title'.tr 'nowhere'.tr")
    out = run_audit(spark, str(tmp_path / "en.json"), str(tmp_path / "ar.json"), code_path=str(tmp_path / "code"))
    got = {(r.key, r.issue_type, r.severity) for r in out["findings"].collect()}
    assert {("home.title", "missing_in_ar", "high"), ("home.x", "grammar", "medium"), ("home.same", "identical_translation", "info"), ("only", "in_en_not_ar", "medium"), ("gone", "empty_ar", "high"), ("nowhere", "missing_in_both", "critical"), ("home.x", "confirmed_unused_key", "low")} <= got
    assert out["summary"].where("dimension = 'total'").first().n == len(got)
    assert out["plan"].count() >= 1


def _plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_audit_is_one_pass(spark):
    from glossa.plans.audit import full_audit

    plan = _plan(full_audit(spark, SF))
    assert plan.count("part.parquet") == 5  # the pairs, twice for duplicates, twice for the glossary
    assert "RoundRobinPartitioning" in plan.rsplit("ArrowEvalPython", 1)[1]  # a table of one row group isn't left to one task


def test_audit_keeps_the_first(spark):
    from glossa.plans.audit import findings

    d = spark.createDataFrame([("k", None, "{x} here"), ("k", "", "{x} here"), ("k", "", "{x} here"), ("j", "Contact with us", "Contact with us")], "key string, en string, ar string")
    got = [r for r in findings(d).collect() if r.key == "k" and r.issue_type == "missing_in_en"]
    assert [(r.old, r.seq.old, r.seq._part, r.severity) for r in got] == [("", None, 7, "high")]
    assert ("j", "grammar") in {(r.key, r.issue_type) for r in findings(d).collect()}


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_arabic_rules_share_their_steps(spark):
    from glossa.operators import arabic as ar
    from glossa.plans import registry

    rules = str(ar.issues(F.col("key"), F.col("ar")))
    assert 0 < rules.count("regexp_") <= 60  # 239 with each use of a masked text written out
    q = registry.queries()
    for name in ("ar_findings", "ar_whitespace", "ar_fuzzy_terms", "shape_issues", "spacing_issues", "text_shapes", "wording_issues", "safe_replacements", "placeholder_tokens", "placeholder_issues", "placeholder_counts"):
        assert "RoundRobinPartitioning" in _plan(q[name](spark, SF)), name
    got = lambda t: one(spark, F.transform(ar.issues(F.lit("k"), F.col("ar")), lambda x: x["issue_type"]), ar=t)
    assert got("") == ["empty_string"] and got("نص  hello") == ["spacing", "mixed_script"] and got("{x}") == []
    assert got("ما {x} , هذا?") == ["english_punctuation"]


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_text_types_cost_little(spark):
    from glossa.operators import queue as qu
    from glossa.plans import registry

    assert 0 < str(qu.text_type(F.col("k"), F.col("v"))).count("regexp_") <= 4  # 100 with the key's tokens written out for each use
    assert "RoundRobinPartitioning" in _plan(registry.queries()["text_types"](spark, SF))
    kind = lambda k, v="one two three four": one(spark, qu.text_type(F.col("k"), F.col("v")), k=k, v=v)
    assert [kind(k) for k in ("a.dialogTitle", "push--body", "sub_title", "subtitles", "btn", "submit.x.TITLE", "__name", "İd")] == ["dialog_title", "notification_body", "subtitle", "unknown", "button", "button", "form_label", "unknown"]
    assert [kind("k", v) for v in ("Save", "Save it.", "", None)] == ["label", "message", "unknown", "unknown"] and kind(None, "Save") == "label"


@pytest.mark.skipif(not os.path.exists(SF), reason="no tables")
def test_key_status_reads_the_code_once(spark):
    from glossa.plans import registry

    d = registry.queries()["key_status"](spark, SF)
    d._jdf.queryExecution().toRdd().count()
    plan = _plan(d).split("Initial Plan")[0]
    assert plan.count("lineitem.parquet") == 1 and "ReusedExchange" in plan
    sides = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    used = spark.createDataFrame([("a", "static"), ("b", "accessor"), ("c", "static"), ("x_", "dynamic"), ("x_1", "dynamic"), ("d", "static"), (None, "static"), (None, "dynamic"), ("n", None)], "key string, mode string")
    got = {r.key: r.status for r in us.key_status(sides("a", "b", "x_1", "y", None), sides("a", "c", "x_2", "x"), used).collect()}
    assert got == {"a": "used", "b": "missing_ar", "c": "missing_en", "d": "missing_in_both", "x_1": "dynamic", "x_2": "dynamic", "x": "unused", "y": "unused"}


def test_scan_looks_at_lines_that_may_match(spark):
    d = spark.createDataFrame([("'a.b'.tr",), ("t('c') __('d')",), ("@lang('e')$t('f')",), ("i18nKey='g' l10n.hX",), ("t('i_' + x)",), ("nothing",), (None,)], "code string")
    assert sorted((r.family, r.key) for r in us.scan(d).collect()) == [("accessor_static", "hX"), ("concat", "i_"), ("function", "c"), ("function", "f"), ("getx", "a.b"), ("laravel", "d"), ("laravel_lang", "e"), ("react", "g"), ("vue", "f")]
