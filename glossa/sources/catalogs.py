"""Catalog sources: JSON objects and PHP arrays to entries; XLSX and source code files.

Files are read by Spark as whole binary files, so many files are read by many tasks; each is parsed by an Arrow function.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.schema import ENTRIES


class CatalogError(ValueError):
    """A catalog that can't be read as one."""


def flatten(tree: object, prefix: str = "") -> list[tuple[str, object]]:
    """(dotted key, leaf) in order; duplicate keys and keys that are also a prefix of others are errors."""
    if not isinstance(tree, dict):
        raise CatalogError("the root must be an object")
    out: list[tuple[str, object]] = []

    def walk(node: dict, path: str) -> None:
        for k, v in node.items():
            full = f"{path}.{k}" if path else str(k)
            if isinstance(v, dict):
                walk(v, full)
            else:
                out.append((full, v))

    walk(tree, prefix)
    seen: set[str] = set()
    for k, _ in out:
        if k in seen:
            raise CatalogError(f"duplicate key: {k}")
        seen.add(k)
    for k in seen:
        parts = k.split(".")
        for i in range(1, len(parts)):
            if ".".join(parts[:i]) in seen:
                raise CatalogError(f"key is also a prefix: {'.'.join(parts[:i])}")
    return out


_PHP = re.compile(r"""\s+|//[^\n]*|\#[^\n]*|/\*.*?\*/|(?P<open>\[|array\s*\()|(?P<close>[\])])|(?P<arrow>=>)|(?P<comma>,)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\$]|\\.)*")|(?P<num>-?\d+)|(?P<end>;)|(?P<ret>return\b)|(?P<php><\?php|\?>)""", re.S)


def php_array(text: str) -> dict:
    """The array that a PHP file returns, without running it. Expressions and interpolation are errors."""
    tokens, at = [], 0
    while at < len(text):
        m = _PHP.match(text, at)
        if not m:
            raise CatalogError(f"unsupported PHP at {at}: {text[at : at + 20]!r}")
        if m.lastgroup and m.lastgroup != "php":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("eof", ""))
    i = 0

    def value() -> object:
        nonlocal i
        kind, raw = tokens[i]
        i += 1
        if kind == "str":
            body = raw[1:-1]
            if raw[0] == "'":
                return re.sub(r"\\([\\'])", r"\1", body)
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)
        if kind == "num":
            return int(raw)
        if kind != "open":
            raise CatalogError(f"unexpected {raw!r}")
        out: dict[str, object] = {}
        index = 0
        while tokens[i][0] != "close":
            v = value()
            if tokens[i][0] == "arrow":
                i += 1
                key, v = str(v), value()
            else:
                key, index = str(index), index + 1
            out[key] = v
            if tokens[i][0] == "comma":
                i += 1
            elif tokens[i][0] != "close":
                raise CatalogError(f"unexpected {tokens[i][1]!r}")
        i += 1
        return out

    if tokens[i][0] != "ret":
        raise CatalogError("no return")
    i += 1
    out = value()
    if not isinstance(out, dict) or tokens[i][0] not in ("end", "eof"):
        raise CatalogError("not a single array")
    return out


def _kind(v: object) -> str:
    return "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "array" if isinstance(v, list) else "string"


def _entries(fmt: str, locale: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                text = bytes(content).decode("utf-8-sig")
                found = flatten(json.loads(text)) if fmt == "json" else flatten(php_array(text), PurePosixPath(path).stem)
                out += [(locale, k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False), _kind(v), n, path) for n, (k, v) in enumerate(found)]
            yield pd.DataFrame(out, columns=["locale", "key", "value", "value_type", "ord", "src_file"])

    return run


def read_catalog(spark: SparkSession, path: str, locale: str, fmt: str = "json") -> DataFrame:
    """Entries of a file or folder; fmt: json or php."""
    if fmt not in ("json", "php"):
        raise CatalogError(f"unknown format: {fmt}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}").load(path).select("path", "content")
    return files.mapInPandas(_entries(fmt, locale), ENTRIES)


def collisions(entries: DataFrame) -> DataFrame:
    """(key, problem): keys that come twice, or are also a prefix of another key."""
    twice = entries.groupBy("locale", "key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("duplicate").alias("problem"))
    parts = F.split("key", r"\.")
    heads = entries.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("key")).distinct()
    return twice.unionByName(entries.select("key").distinct().join(heads, "key", "left_semi").select("key", F.lit("prefix").alias("problem")))


def read_code(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, line, code) of all source files with one of the suffixes."""
    glob = "*{" + ",".join(suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))  # bytes that aren't UTF-8 become U+FFFD
    return files.select("path", F.posexplode(F.split(text, "\r?\n")).alias("line", "code")).select("path", (F.col("line") + 1).alias("line"), "code")


OOXML = "http://schemas.openxmlformats.org"
_NS = f"{{{OOXML}/spreadsheetml/2006/main}}"


def parse_xlsx(data: bytes) -> list[dict]:
    """The rows of the first sheet by their header; short rows are filled with ''."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        grid = []
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{_NS}row"):
            cells: dict[int, str] = {}
            for n, c in enumerate(row.iter(f"{_NS}c")):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = column_index(letters) if letters else n
                v, t = c.find(f"{_NS}v"), c.get("t")
                raw = "".join(x.text or "" for x in c.iter(f"{_NS}t")) if t == "inlineStr" else (v.text if v is not None else "") or ""
                cells[at] = shared[int(raw)] if t == "s" else raw
            grid.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    if not grid:
        return []
    head, *rest = grid
    return [dict(zip(head, [*r, *[""] * (len(head) - len(r))])) for r in rest]


def column_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def read_xlsx(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A row for each row of the workbooks, the required columns as strings; a workbook without one of them is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                got = parse_xlsx(bytes(content))
                if got and (lack := [c for c in required if c not in got[0]]):
                    raise CatalogError(f"columns missing: {lack}")
                yield pd.DataFrame([[r[c] for c in required] for r in got], columns=required)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in required))


def read_glossary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ord, term_en, approved, forbidden) a row for each forbidden form, and the global (forbidden, use_instead)."""
    schema = "terms array<struct<term_en:string,approved_ar:string,forbidden_ar:array<string>>>, rules struct<forbidden_terms:array<struct<forbidden_ar:string,use_instead:string>>>"
    d = spark.read.schema(schema).json(path, multiLine=True)
    terms = d.select(F.posexplode("terms").alias("ord", "t")).select("ord", F.col("t.term_en").alias("term_en"), F.col("t.approved_ar").alias("approved"), F.explode_outer("t.forbidden_ar").alias("forbidden")).where("term_en is not null")
    return terms, d.select(F.explode("rules.forbidden_terms").alias("f")).select(F.col("f.forbidden_ar").alias("forbidden"), "f.use_instead")
