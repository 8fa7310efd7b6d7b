"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
_MODULES = ("texts", "arabic", "pairs", "findings", "review", "decisions", "usage", "queue", "reports", "records", "audit")


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        _queries[key] = f
        if sql:
            _sql[key] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        import_module(f"glossa.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
