"""Placeholders of six styles, and the comparison of two texts by them.

``parse`` gives exact tokens in one Arrow pass: earlier styles win over later ones where they overlap, ``#`` counts inside ICU
messages. The comparison is array functions on two such columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions import text as tx

_NAME = r"[A-Za-z0-9_]+"
_STYLES = {"dollar_brace": rf"\$\{{({_NAME})\}}", "mustache": rf"\{{\{{({_NAME})\}}\}}", "brace": rf"\{{({_NAME})\}}", "printf": r"%(?:([0-9]+)\$)?([sdfox@])", "dollar_index": r"\$(\d+)", "colon": r"(?a::([^\W\d]\w*))"}
_COMPILED = {k: re.compile(v) for k, v in _STYLES.items()}
_ICU = re.compile(r"(?i)[{][^{}]+,\s*(?:selectordinal|plural|select)\s*,")
_MAY = re.compile(r"[${%:]")
_SCHEME = re.compile(r"(?:^|[^A-Za-z0-9+.-])(?:https?|mailto|tel|ftp|file)$", re.I)
SCHEMA = "array<struct<raw:string,style:string,canonical:string,start:int>>"


def tokens(text: str) -> list[tuple[str, str, str, int]]:
    """(raw, style, canonical, start), by start."""
    if not _MAY.search(text):
        return []
    taken = bytearray(len(text))
    out, unnamed = [], 0
    for style, rx in _COMPILED.items():
        for m in rx.finditer(text):
            a, z = m.span()
            if style == "printf":
                place = m[1]
                if not place:
                    place, unnamed = str(unnamed), unnamed + 1
                canonical = f"%{m[2]}:{place}"
            elif style == "dollar_index":
                canonical = "$" + m[1]
            elif style == "colon":
                before = text[a - 1] if a else ""
                after = text[z : z + 1]
                if before.isalnum() or (before and before in "-`/\\") or (after and after in "@/\\") or _SCHEME.search(text[max(0, a - 8) : a]):
                    continue
                canonical = ":" + m[1]
            else:
                canonical = m[1]
            if not any(taken[a:z]):
                taken[a:z] = b"\1" * (z - a)
                out.append((m[0], style, canonical, a))
    if "#" in text and _ICU.search(text):
        out += [("#", "icu_pound", "#", i) for i, ch in enumerate(text) if ch == "#" and not taken[i]]
    return sorted(out, key=lambda t: t[3])


def parse(c: Column) -> Column:
    """Array of (raw, style, canonical, start); empty for null."""

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys = ("raw", "style", "canonical", "start")
        for s in batches:
            yield s.map(lambda t: [dict(zip(keys, x)) for x in tokens(t)] if t else []).astype(object)

    return run(c)


def _field(items: Column, name: str) -> Column:
    return F.transform(items, lambda x: x[name])


def _more(a: Column, b: Column) -> Column:
    """Distinct values that a has more often than b, sorted."""
    n = lambda arr, v: F.size(F.filter(arr, lambda x: x == v))
    return F.array_sort(F.filter(F.array_distinct(a), lambda v: n(a, v) > n(b, v)))


def compare(en: Column, ar: Column) -> Column:
    """Array of (issue_type, severity, message) for the parsed columns of a pair."""
    none = F.array().cast("array<struct<issue_type:string,severity:string,message:string>>")
    return F.when((F.size(en) == 0) & (F.size(ar) == 0), none).otherwise(tx.let(F.struct(en.alias("en"), ar.alias("ar")), lambda x: _compare(x["en"], x["ar"])))


def _compare(en: Column, ar: Column) -> Column:
    ec, ac, es, as_ = _field(en, "canonical"), _field(ar, "canonical"), _field(en, "style"), _field(ar, "style")
    named = lambda items: F.transform(F.filter(items, lambda x: x["style"] != "printf"), lambda x: x["canonical"])
    same_set = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    en_names, ar_names = named(en), named(ar)
    renamed = (F.size(en_names) > 0) & (F.size(en) == F.size(ar)) & (F.size(en_names) == F.size(ar_names)) & (F.array_sort(es) == F.array_sort(as_)) & ~same_set(en_names, ar_names)
    return tx.let(F.struct(renamed.alias("renamed"), _more(ec, ac).alias("gone"), _more(ac, ec).alias("extra")), lambda x: _rows(en, ar, x["renamed"], x["gone"], x["extra"]))


def _rows(en: Column, ar: Column, renamed: Column, gone: Column, extra: Column) -> Column:
    ec, ac, es, as_ = _field(en, "canonical"), _field(ar, "canonical"), _field(en, "style"), _field(ar, "style")
    same_set = lambda a, b: F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
    styles = lambda items, v: F.array_sort(F.array_distinct(F.transform(F.filter(items, lambda x: x["canonical"] == v), lambda x: x["style"])))
    formats = F.array_sort(F.filter(F.array_intersect(ec, ac), lambda v: styles(en, v) != styles(ar, v)))
    risky = F.exists(F.concat(es, as_), lambda s: ~s.isin("colon", "icu_pound"))
    both = (F.size(en) > 0) & (F.size(ar) > 0)
    missing = ~renamed & ((F.size(gone) > 0) | (F.size(extra) > 0))

    def row(when: Column, kind: str, severity, message) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.when(when, F.struct(F.lit(kind).alias("issue_type"), lit(severity).alias("severity"), lit(message).alias("message")))

    rows = [
        row(renamed, "renamed_placeholder", "medium", "names differ"),
        row(~renamed & (F.size(gone) > 0), "missing_in_ar", "high", F.concat(F.lit("missing: "), F.array_join(gone, ", "))),
        row(~renamed & (F.size(extra) > 0), "missing_in_en", "high", F.concat(F.lit("missing: "), F.array_join(extra, ", "))),
        row(F.size(en) != F.size(ar), "count_mismatch", "high", "counts differ"),
        row(F.size(formats) > 0, "format_mismatch", "high", F.concat(F.lit("formats differ: "), F.array_join(formats, ", "))),
        row(both & (F.array_sort(ec) == F.array_sort(ac)) & (ec != ac), "order_mismatch", F.when(risky, "high").otherwise("low"), "order differs"),
        row(both & ~same_set(es, as_) & ~missing, "mixed_placeholder_style", "medium", "styles differ"),
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())
