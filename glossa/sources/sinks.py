"""Sinks: guarded CSV, JSON and PHP catalogs, XLSX, Markdown, run history."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import csv_guard
from glossa.sources.catalogs import OOXML, column_name


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, in which no string can be a formula."""
    guarded = [csv_guard(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*guarded).write.mode("overwrite").option("header", True).csv(path)


def catalog_json(entries: DataFrame) -> DataFrame:
    """(locale, document): one flat JSON object for each locale, in the entries' order."""
    pairs = F.array_sort(F.collect_list(F.struct("ord", "key", "value")))
    body = F.array_join(F.transform(pairs, lambda x: F.concat(F.lit("  "), F.to_json(F.array(x["key"])).substr(F.lit(2), F.length(F.to_json(F.array(x["key"]))) - 2), F.lit(": "), F.to_json(F.array(x["value"])).substr(F.lit(2), F.length(F.to_json(F.array(x["value"]))) - 2))), ",\n")
    return entries.groupBy("locale").agg(F.concat(F.lit("{\n"), body, F.lit("\n}\n")).alias("document"))


def php_document(pairs: Iterable[tuple[str, str]]) -> str:
    """A PHP file that returns the nested array of dotted keys; a key that is also a prefix stays flat."""
    pairs = list(pairs)
    keys = {k for k, _ in pairs}
    tree: dict = {}
    for k, v in pairs:
        parts = k.split(".")
        if any(".".join(parts[:i]) in keys for i in range(1, len(parts))):
            tree[k] = v
            continue
        node = tree
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = v

    def quote(s: str) -> str:
        return "'" + re.sub(r"([\\'])", r"\\\1", s) + "'"

    def body(node: dict, depth: int) -> str:
        pad = "    " * depth
        return "".join(f"{pad}{quote(k)} => " + (f"[\n{body(v, depth + 1)}{pad}],\n" if isinstance(v, dict) else f"{quote(v)},\n") for k, v in node.items())

    return f"<?php\n\nreturn [\n{body(tree, 1)}];\n"


def catalog_php(entries: DataFrame) -> DataFrame:
    """(group, document): a PHP file for each first segment of the keys."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "document": [php_document(zip(pdf["rest"], pdf["value"]))]})

    d = entries.select(F.substring_index("key", ".", 1).alias("group"), F.expr("CASE WHEN instr(key, '.') > 0 THEN substr(key, instr(key, '.') + 1) ELSE key END").alias("rest"), "value", "ord")
    return d.groupBy("group").applyInPandas(one, "group string, document string")


def _tag(name: str, inside: str = "", **attributes: str) -> str:
    head = "".join(f' {k}="{v}"' for k, v in attributes.items())
    return f"<{name}{head}>{inside}</{name}>" if inside else f"<{name}{head}/>"


def xlsx_bytes(columns: list[str], rows: Iterable[Iterable[object]]) -> bytes:
    """A workbook of one sheet."""
    def cell(r: int, c: int, v: object) -> str:
        return f'<c r="{column_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'

    lines = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate([columns, *rows], 1))
    kind = "application/vnd.openxmlformats-"
    relations, main, link = f"{OOXML}/package/2006/relationships", f"{OOXML}/spreadsheetml/2006/main", f"{OOXML}/officeDocument/2006/relationships"

    def relation(what: str, target: str) -> str:
        return _tag("Relationships", _tag("Relationship", Id="r1", Type=f"{link}/{what}", Target=target), xmlns=relations)

    office = f"{kind}officedocument.spreadsheetml."
    types = _tag("Default", Extension="xml", ContentType="application/xml") + _tag("Default", Extension="rels", ContentType=f"{kind}package.relationships+xml")
    types += _tag("Override", PartName="/xl/workbook.xml", ContentType=f"{office}sheet.main+xml") + _tag("Override", PartName="/xl/worksheets/sheet1.xml", ContentType=f"{office}worksheet+xml")
    parts = {
        "[Content_Types].xml": _tag("Types", types, xmlns=f"{OOXML}/package/2006/content-types"),
        "_rels/.rels": relation("officeDocument", "xl/workbook.xml"),
        "xl/workbook.xml": _tag("workbook", _tag("sheets", '<sheet name="Sheet1" sheetId="1" r:id="r1"/>'), xmlns=main, **{"xmlns:r": link}),
        "xl/_rels/workbook.xml.rels": relation("worksheet", "worksheets/sheet1.xml"),
        "xl/worksheets/sheet1.xml": _tag("worksheet", _tag("sheetData", lines), xmlns=main),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def markdown(summary: DataFrame, top: DataFrame) -> str:
    """A dashboard of the summary (dimension, value, n) and of the top issues; both are small reports."""
    lines = ["# Audit", ""]
    for r in summary.where("dimension = 'severity'").orderBy("value").collect():
        lines.append(f"- {r.value}: {r.n}")
    lines += ["", "| key | type | severity |", "|-|-|-|"]
    lines += [f"| {r.key} | {r.issue_type} | {r.severity} |" for r in top.limit(30).collect()]
    return "\n".join(lines) + "\n"


def append_run(history: DataFrame, run: DataFrame, most: int = 500) -> DataFrame:
    """The newest runs (project, ts, id, …) of each project after a run is added; of the same time the greater id."""
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("ts"), F.desc("id")))
    return history.unionByName(run, allowMissingColumns=True).withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def json_document(df: DataFrame) -> str:
    """A small report as one JSON document."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], ensure_ascii=False, indent=2, default=str)
