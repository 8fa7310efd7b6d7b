"""Key usage in source code: patterns, aggregation, key status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (family, mode, pattern); group 1 is the key, or the fixed prefix of a dynamic one.
PATTERNS = [
    ("getx", "static", r"""["']([A-Za-z0-9_.-]+)["']\.tr\b"""),
    ("function", "static", r"""\bt\(["']([A-Za-z0-9_.-]+)["']\)"""),
    ("laravel", "static", r"""__\(["']([A-Za-z0-9_.-]+)["']\)"""),
    ("laravel_lang", "static", r"""@lang\(["']([A-Za-z0-9_.-]+)["']\)"""),
    ("vue", "static", r"""\$t\(["']([A-Za-z0-9_.-]+)["']\)"""),
    ("react", "static", r"""i18nKey=["']([A-Za-z0-9_.-]+)["']"""),
    ("accessor_static", "accessor", r"""\bl10n\.([a-z][A-Za-z0-9]*)"""),
    ("concat", "dynamic", r"""\bt\(["']([A-Za-z0-9_.-]+)["'] \+ """),
]
#: What a line must have for a pattern to match; the pattern runs on such lines alone.
_NEEDS = dict(zip((rx for *_, rx in PATTERNS), (".tr", "t(", "__(", "@lang(", "$t(", "i18nKey=", "l10n.", " + "), strict=True))
_KEY = r"""(?:'([^'"\r\n]+)'|"([^'"\r\n]+)")"""
_ARG = r"""(?![\s'"])([^)\r\n]+?)\s*[,)]"""


def _call(head: str, key: str, dynamic: str, name: str, prefix: str = "") -> list[tuple[str, str, str]]:
    """The static pattern of a call with a quoted key, and that of one with an expression."""
    return [(key, "suspicious" if key.endswith("suspicious") else "static", rf"{head}\s*\(\s*{prefix}{_KEY}"), (dynamic, "suspicious" if dynamic.endswith("suspicious") else "dynamic", rf"{head}\s*\(\s*{prefix}{_ARG}")]


#: The built-in patterns of all frameworks: (family, mode, pattern). The key, or the expression, is the first group that matches.
BUILTIN = [
    ("getx_static", "static", _KEY + r"\s*\.tr\b"),
    ("getx_dynamic", "dynamic", r"\b([A-Za-z_][A-Za-z0-9_.$>\-?]*)\s*\.tr\b"),
    *_call(r"(?<![\w.$])tr", "getx_static", "getx_dynamic", "tr"),
    *_call(r"(?<![\w.$])translate", "translate_static", "translate_dynamic", "translate"),
    ("getx_static", "static", rf"\bgetTranslated\s*\(\s*{_KEY}"),
    *_call(r"\.translate", "translate_suspicious", "translate_suspicious", "dot_translate"),
    *_call(r"(?<![\w.$])translate", "laravel_custom_static", "laravel_custom_dynamic", "custom", r"(?:key\s*:\s*)?"),
    *_call(r"\b__", "laravel_static", "laravel_dynamic", "helper"),
    *_call("@lang", "laravel_static", "laravel_dynamic", "directive"),
    *_call(r"\btrans", "laravel_static", "laravel_dynamic", "trans"),
    *_call(r"(?<![\w.$])t", "react_static", "react_dynamic", "t"),
    *_call(r"\bi18n\.t", "react_static", "react_dynamic", "i18n"),
    *_call(r"\$t", "vue_static", "vue_dynamic", "vue"),
    ("inferred", "dynamic", r"""['"]([^'"\r\n]*\$\{.*?\}[^'"\r\n]*)['"]\s*\.tr\b"""),
    ("inferred_prefix", "dynamic", r"""['"]([A-Za-z0-9_-]+)['"]\s*\+\s*[A-Za-z_]\w*"""),
    ("inferred_suffix", "dynamic", r"""[A-Za-z_]\w*\s*\+\s*['"]([A-Za-z0-9_-]+)['"]"""),
    ("inferred_both", "dynamic", r"""['"]([A-Za-z0-9_-]+)['"]\s*\+\s*[A-Za-z_]\w*\s*\+\s*['"][A-Za-z0-9_-]+['"]"""),
]
CONFIDENCE = {"static": 1.0, "accessor": 0.95, "dynamic": 0.65}


def scan(lines: DataFrame, col: str = "code", patterns: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """lines with (family, mode, key) for each use; accessors are turned to snake case by ``normalize_keys``."""
    def uses(family: str, mode: str, rx: str) -> Column:
        if _KEY in rx:
            one, two = (F.regexp_extract_all(F.col(col), F.lit(rx), n) for n in (1, 2))
            found = F.zip_with(one, two, lambda x, y: F.when(x == "", y).otherwise(x))
        else:
            found = F.regexp_extract_all(F.col(col), F.lit(rx), 1)
        if rx in _NEEDS:
            found = F.when(F.col(col).contains(_NEEDS[rx]), found).otherwise(F.array().cast("array<string>"))
        return F.transform(found, lambda k: F.struct(F.lit(family).alias("family"), F.lit(mode).alias("mode"), k.alias("key")))

    found = F.flatten(F.array(*[uses(*p) for p in patterns or PATTERNS]))
    return lines.select("*", F.explode(found).alias("_x")).select(*[c for c in lines.columns if c != "key"], "_x.*")


def normalize_keys(used: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keys as the catalog has them: as they are, without 'lang.', or in snake case; else as they are."""
    from glossa.functions.text import camel_to_snake

    keys = catalog.select("key").distinct()
    d = used.withColumn("_l", F.regexp_replace("key", r"^lang\.", "")).withColumn("_s", camel_to_snake(F.col("key")))
    for c, name in (("key", "_k0"), ("_l", "_k1"), ("_s", "_k2")):
        d = d.join(keys.select(F.col("key").alias(name)), F.col(c) == F.col(name), "left")
    return d.withColumn("key", F.coalesce("_k0", "_k1", "_k2", "key")).drop("_l", "_s", "_k0", "_k1", "_k2")


def metadata(code: Column) -> Column:
    """Where a text is shown, by what surrounds its use; the first that fits."""
    c = F.lower(code)
    out = None
    for place, words in (("dialog", ("showdialog", "alertdialog", "modal")), ("snackbar", ("snackbar", "toast")), ("helper_text", ("helpertext", "helper")), ("form_hint", ("hinttext", "placeholder")), ("button", ("button", "onpressed")), ("title", ("appbar", "title")), ("label", ("label",)), ("body", ("text(",))):
        hit = c.contains(words[0])
        for w in words[1:]:
            hit = hit | c.contains(w)
        out = F.when(hit, place) if out is None else out.when(hit, place)
    return out.otherwise("unknown")


_LOCATIONS = [
    ("snackbar", ("snackbar", "flushbar", "scaffoldmessenger")), ("toast", ("toast",)), ("notification_title", ("notification_title",)), ("notification_body", ("notification_body", "pushbody")),
    ("subtitle", ("subtitle",)), ("helper_text", ("helper",)), ("form_hint", ("hinttext", "placeholder")), ("form_label", ("labeltext", "formfield", "textfield")), ("dialog_title", None),
    ("dialog_body", ("dialog", "modal")), ("title", ("appbar", "title:", "screen_title")), ("button", ("elevatedbutton", "textbutton", "outlinedbutton", "iconbutton", "button(")),
]
_SURFACES = {"dialog": ("dialog_title", "dialog_body"), "notification": ("notification_title", "notification_body"), "feedback": ("snackbar", "toast"), "form": ("form_label", "form_hint", "helper_text"), "screen": ("title", "subtitle"), "action": ("button",)}
_ROLES = {"label": ("button", "form_label", "title", "dialog_title", "notification_title"), "message": ("form_hint", "helper_text", "subtitle", "dialog_body", "notification_body", "snackbar", "toast")}
_ACTS = {"action": "save submit continue next retry confirm approve send delete add create tap click press".split(), "status": "error failed warning invalid required success done".split()}


def attributes(code: Column, roles: tuple[str, ...] = ()) -> Column:
    """A struct (location, surface, role, action, audience) of a use, by what stands around it; the file's name may be put before the code."""
    c = F.lower(code)
    any_of = lambda words: F.coalesce(*[F.when(c.contains(w), True) for w in words], F.lit(False))
    location = F.lit("unknown")
    for name, words in reversed(_LOCATIONS):
        location = F.when(any_of(words) if words else c.contains("alertdialog") & c.contains("title"), name).otherwise(location)

    def of(table: dict, other: str) -> Column:
        out = F.lit(other)
        for name, places in table.items():
            out = F.when(location.isin(*places), name).otherwise(out)
        return out

    action = F.when(any_of(_ACTS["action"]), "action").when(any_of(_ACTS["status"]), "status").otherwise("inform")
    audience = F.when(any_of(roles), "role_specific").otherwise("general") if roles else F.lit("general")
    return F.struct(location.alias("location"), of(_SURFACES, "generic").alias("surface"), of(_ROLES, "body").alias("role"), action.alias("action"), audience.alias("audience"))


def aggregate(used: DataFrame) -> DataFrame:
    """(key, n, families, places, confidence) over uses (key, family, mode, place)."""
    conf = F.when(F.col("mode") == "static", CONFIDENCE["static"]).when(F.col("mode") == "accessor", CONFIDENCE["accessor"]).otherwise(CONFIDENCE["dynamic"])
    g = used.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.array_join(F.array_sort(F.collect_set("place")), ",").alias("places"), F.max(conf).alias("confidence"))
    return g


def dynamic_matches(keys: DataFrame, used: DataFrame) -> DataFrame:
    """(key, prefix) for catalog keys that begin with the prefix of a dynamic use.

    A prefix match is an equi join once keys are cut to the lengths that prefixes have; those lengths are a handful.
    """
    prefixes = used.where("mode = 'dynamic'").select(F.col("key").alias("prefix")).distinct()
    lengths = prefixes.select(F.coalesce(F.length("prefix"), F.lit(-1)).alias("m")).distinct()  # never null: a filter on it would set this reading of the uses apart from the others
    cuts = keys.select("key").join(F.broadcast(lengths), F.length("key") >= F.col("m")).select("key", F.expr("left(key, m)").alias("_p"))
    return cuts.join(prefixes, F.col("_p") == F.col("prefix")).select("key", "prefix")


def key_status(en: DataFrame, ar: DataFrame, used: DataFrame) -> DataFrame:
    """(key, status) for each key of the catalogs or the code: missing_in_both, missing_ar, missing_en, unused, dynamic or used.

    Catalogs and uses are folded to one row of bits a key (1 en, 2 ar, 4 used, 8 prefix of a dynamic use); all steps read that one shuffle, so the code is read once.
    """
    bit = lambda d, b: d.select("key", b.alias("b"))
    mode = F.col("mode")
    rows = bit(en, F.lit(1)).unionAll(bit(ar, F.lit(2))).unionAll(bit(used, F.when(mode == "dynamic", 8).when(mode.isNotNull(), 4).otherwise(0)))
    d = rows.where("key is not null").groupBy("key").agg(F.bit_or("b").alias("b"))  # one column, and filters on it alone: else each step would have a shuffle of its own
    has = lambda bits: F.col("b").bitwiseAND(bits) != 0
    dyn = dynamic_matches(d.where(~has(4) & has(3)), d.where(has(8)).select("key", F.lit("dynamic").alias("mode"))).select("key", F.lit(True).alias("d")).distinct()
    d = d.where(has(7)).join(dyn, "key", "left")
    status = F.when(~has(3), "missing_in_both").when(has(4) & ~has(2), "missing_ar").when(has(4) & ~has(1), "missing_en").when(has(4), "used").when(F.col("d").isNotNull(), "dynamic").otherwise("unused")
    return d.select("key", status.alias("status"))
