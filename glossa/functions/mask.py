"""Placeholders behind a mark while a text is rewritten, as column expressions.

A placeholder becomes the private-use character MARK, which no rule of spacing or punctuation touches; ``unmask`` puts the originals back in
their order. A MARK of the text's own counts as a placeholder, so that it comes back as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions import text as tx

MARK = ""
TOKEN = r"\$\{\w+\}|\{\{\w+\}\}|\{\w+\}|%(?:\d+\$)?[@sdfox]|\$\d+|(?<![\p{L}\p{N}/\\`-]):[A-Za-z_]\w*+(?![/\\@])|" + MARK


def _may(c: Column) -> Column:
    """Whether a text has a character that each placeholder has one of; the pattern runs on these texts alone."""
    return c.rlike(r"[${%:" + MARK + "]")


def tokens(c: Column) -> Column:
    """The placeholders of a text in their order; '#' is one in an ICU message."""
    return F.when(c.isNotNull() & ~_may(c), F.array().cast("array<string>")).when(tx.has_icu(c), F.regexp_extract_all(c, F.lit(TOKEN + "|#"), 0)).otherwise(F.regexp_extract_all(c, F.lit(TOKEN), 0))


def mask(c: Column) -> Column:
    return F.when(~_may(c), c).when(tx.has_icu(c), F.regexp_replace(c, TOKEN + "|#", MARK)).otherwise(F.regexp_replace(c, TOKEN, MARK))


def masked(c: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of the masked text and its placeholders, each computed once a row."""
    return tx.let(F.struct(mask(c).alias("m"), tokens(c).alias("found")), lambda x: f(x["m"], x["found"]))


def unmask(masked: Column, found: Column) -> Column:
    """masked with its n-th mark replaced by the n-th of found."""
    return F.array_join(F.transform(F.split(masked, MARK), lambda part, i: F.concat(part, F.coalesce(F.get(found, i), F.lit("")))), "")
