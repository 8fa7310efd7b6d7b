"""ICU messages: a recursive parser behind an Arrow function, and the comparison of two messages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HEAD = re.compile(r"\s*([^\W\d]\w*)\s*,\s*(plural|selectordinal|select)\s*,", re.I | re.A)
_BRANCH = re.compile(r"\s*(offset:\d+|=\d+|[^\W\d]\w*)\s*", re.A)
_ARGUMENT = re.compile(r"\{\s*([A-Za-z0-9_]+)\s*\}")


def _close(text: str, at: int) -> int:
    """The place of the brace that closes the one at ``at``; -1 if there is none."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i
    return -1


def parse(text: str, path: str = "") -> tuple[list[dict], list[str]]:
    """Nodes (path, name, kind, branches: selector to text) in order, inner ones after their outer ones; and errors."""
    nodes, errors, i = [], [], 0
    while (i := text.find("{", i)) >= 0:
        end = _close(text, i)
        if end < 0:
            errors.append("unbalanced_braces")
            break
        head = _HEAD.match(text, i + 1)
        if head and head.end() <= end:
            branches, at = {}, head.end()
            while at < end:
                m = _BRANCH.match(text, at)
                if not m or m.end() > end:
                    if text[at:end].strip():
                        errors.append("bad_branch")
                    break
                if m[1].startswith("offset:"):
                    at = m.end()
                    continue
                close = _close(text, m.end()) if text[m.end() : m.end() + 1] == "{" else -1
                if not 0 <= close < end:
                    errors.append("bad_branch")
                    break
                branches[m[1]] = text[m.end() + 1 : close]
                at = close + 1
            own = f"{path}/{head[1]}"
            nodes.append({"path": own, "kind": head[2].lower(), "branches": branches})
            for k, inner in branches.items():
                more, wrong = parse(inner, f"{own}:{k}")
                nodes += more
                errors += wrong
        i = end + 1
    if not errors and text.count("{") != text.count("}") and not path:
        errors.append("unbalanced_braces")
    return nodes, errors


def signature(text: str) -> str:
    """The sorted arguments of a text, '#' among them."""
    return " ".join(sorted(_ARGUMENT.findall(text) + ["#"] * text.count("#")))


def compare(en: str, ar: str) -> list[str]:
    """Issue types of a pair, in order, each once."""
    (left, wrong_left), (right, wrong_right) = parse(en), parse(ar)
    if not left and not right and not wrong_left and not wrong_right:
        return []
    if wrong_left or wrong_right:
        return ["icu_syntax_error"] if left or right else []
    if left and not right:
        return ["icu_literal_text_only"]
    out = []
    if any("other" not in n["branches"] for n in left + right):
        out.append("icu_branch_incomplete")
    if len(left) != len(right):
        out.append("icu_branch_mismatch")
    for a, b in zip(left, right):
        if a["kind"] != b["kind"] or set(a["branches"]) != set(b["branches"]):
            out.append("icu_branch_mismatch")
        if any(signature(a["branches"][k]) != signature(b["branches"][k]) for k in a["branches"].keys() & b["branches"].keys()):
            out.append("icu_placeholder_mismatch")
        if a["path"] != b["path"]:
            out.append("icu_suspicious_variation")
    return list(dict.fromkeys(out))


def issues(en: Column, ar: Column) -> Column:
    """Array of the issue types of a pair of columns."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([compare(x or "", y or "") for x, y in zip(a, b)], dtype=object)

    return run(en, ar)
