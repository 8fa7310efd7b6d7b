"""Model providers: any object with ``review(items) -> answers`` is called by the tasks, in batches, with retries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    def review(self, items: list[dict]) -> list[dict]:
        """Answers (key, suggestion) to items (key, source, ...); keys may lack."""


class Mock:
    """Answers each item with its source in brackets."""

    def review(self, items: list[dict]) -> list[dict]:
        return [{"key": x["key"], "suggestion": f"[{x['source']}]"} for x in items]


def review(items: DataFrame, provider: Provider, size: int = 20, retries: int = 2, breaker: int = 3) -> DataFrame:
    """(key, suggestion, error) for each row of items (key, source). Keys without a valid answer are asked again up to ``retries`` times; after ``breaker``
    failures in a row a task asks no more, and its rows get the error circuit_open."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for f in frames:
            out: dict[int, tuple] = {}
            for s in range(0, len(f), size):
                left = list(range(s, min(s + size, len(f))))
                error = "no_answer"
                for _ in range(retries + 1):
                    if not left or failed >= breaker:
                        break
                    try:
                        got = {a["key"]: a.get("suggestion") for a in provider.review(f.iloc[left].to_dict("records"))}
                        failed, error = 0, "no_answer"
                    except Exception as e:  # a provider may fail in any way; the row says how
                        failed += 1
                        error = type(e).__name__
                        continue
                    for i in left:
                        if got.get(f["key"].iloc[i]):
                            out[i] = (got[f["key"].iloc[i]], None)
                    left = [i for i in left if i not in out]
                for i in left:
                    out[i] = (None, "circuit_open" if failed >= breaker else error)
            yield pd.DataFrame({"key": f["key"], "suggestion": [out[i][0] for i in range(len(f))], "error": [out[i][1] for i in range(len(f))]})

    return items.select("key", "source").mapInPandas(run, "key string, suggestion string, error string")
