"""Feedback signals in event-time windows; the same function serves batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(signals: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """(start, route, n, accepted) for each window and route of signals (ts, route, accepted). On a stream, rows later than ``late`` behind the newest are dropped."""
    d = signals.select(F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.nullif("route", F.lit("")), F.lit("unknown")).alias("route"), "accepted")
    if d.isStreaming:
        d = d.withWatermark("ts", late)
    g = d.groupBy(F.window("ts", width).alias("w"), "route").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))
    return g.select(F.col("w.start").alias("start"), "route", "n", "accepted")


def audit_stream(entries: DataFrame) -> DataFrame:
    """Row-local rules over a stream of pairs (key, en, ar): they hold no state."""
    from glossa.operators.pairs import spacing_findings

    return spacing_findings(entries)
