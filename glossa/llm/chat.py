"""Chat formatting into windows of a token budget.

A conversation's turns are put in order of turn, role and text; the first system turn is set apart and stands at the head of every
window. Prefix sums of the other turns' tokens choose the windows: one that begins with turn i repeats before it the
longest run of earlier turns that has at most ``history`` tokens and leaves room for i, and goes on to the last turn that fits
the budget. Each turn is new in just one window. Targets are the new assistant turns; repeated ones, and all other
roles, are masked.

A turn's tokens are its runs of characters other than blank, tab, newline and carriage return, and two for its marks.

Edge cases: a null role or text counts as ''. Rows without a conversation id are left out; a null turn comes first. Turns with
equal numbers go by role and text, repeated rows are turns of their own. A turn that is too long for the budget has a window of its own (with
the system turn) and is flagged ``over``; nothing is cut. A conversation of one system turn alone has no window. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import lean

BUDGET, HISTORY, MARKS = 128, 32, 2
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_history", pa.int64()), ("n_turns", pa.int64()), ("n_tokens", pa.int64()), ("n_targets", pa.int64()), ("targets", pa.string()), ("over", pa.bool_()), ("text", pa.string())])


def spans(n: np.ndarray, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(start of the history, first new turn, end) of each window over turns of n tokens."""
    before = np.r_[0, np.cumsum(n)]
    out, i = [], 0
    while i < len(n):
        room = max(0, min(history, budget - int(n[i])))
        s = int(np.searchsorted(before[: i + 1], before[i] - room))
        end = max(i + 1, int(np.searchsorted(before, before[s] + budget, "right")) - 1)
        out.append((s, i, end))
        i = end
    return out


def _windows(conv: int, turns: list, roles: list, texts: list, n: list, budget: int, history: int) -> Iterator[dict]:
    head = next((i for i, r in enumerate(roles) if r == "system"), None)
    rest = [i for i in range(len(turns)) if i != head]
    lead, used = ("", 0) if head is None else (f"<|system|>\n{texts[head]}<|end|>\n", n[head])
    for k, (s, i, end) in enumerate(spans(np.array([n[j] for j in rest], np.int64), budget - used, history)):
        own = rest[s:end]
        target = [j >= i and roles[rest[j]] == "assistant" for j in range(s, end)]
        tokens = used + sum(n[j] for j in own)
        yield {"conv_id": conv, "window": k, "first_turn": turns[rest[i]], "last_turn": turns[rest[end - 1]], "n_history": i - s, "n_turns": end - i, "n_tokens": tokens, "n_targets": sum(n[j] for j, t in zip(own, target) if t), "targets": "0" * (head is not None) + "".join("01"[t] for t in target), "over": tokens > budget, "text": lead + "".join(f"<|{roles[j]}|>\n{texts[j]}<|end|>\n" for j in own)}


def _format(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, out = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and row[0] != conv:
                    out += _windows(conv, *map(list, zip(*held)), budget, history)
                    held = []
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                        out = []
                conv = row[0]
                held.append(row[1:])
        if held:
            out += _windows(conv, *map(list, zip(*held)), budget, history)
        yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return run


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of all conversations of turns (conv_id, turn, role, text): one row each, with the formatted text and a digit for each of its turns that is 1 for targets."""
    n = F.regexp_count("text", F.lit(r"[^ \t\n\r]+")).cast("bigint") + MARKS
    d = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.where("conv_id is not null").withColumn("n", n)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "conv_id bigint, window bigint, first_turn bigint, last_turn bigint, n_history bigint, n_turns bigint, n_tokens bigint, n_targets bigint, targets string, over boolean, text string"
    return d.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(lean(_format(budget, history)), schema)


SQL = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) + {MARKS} AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, min(rn) AS hrn FROM t WHERE role = 'system' GROUP BY conv_id),
hd AS (SELECT t.conv_id, t.n AS hn, '<|system|>' || chr(10) || t.text || '<|end|>' || chr(10) AS lead FROM t JOIN h ON t.conv_id = h.conv_id AND t.rn = h.hrn),
o AS (SELECT t.*, coalesce(hn, 0) AS hn, lead, {BUDGET} - coalesce(hn, 0) AS b,
             row_number() OVER (PARTITION BY t.conv_id ORDER BY rn) AS i,
             sum(n) OVER (PARTITION BY t.conv_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS p
      FROM t LEFT JOIN h ON t.conv_id = h.conv_id LEFT JOIN hd ON t.conv_id = hd.conv_id WHERE h.hrn IS NULL OR t.rn <> h.hrn),
s AS (SELECT x.conv_id, x.i, x.b, min(y.i) AS s, min(y.p - y.n) AS before
      FROM o x JOIN o y ON x.conv_id = y.conv_id AND y.i <= x.i
       AND (x.p - x.n) - (y.p - y.n) <= greatest(0, least({HISTORY}, x.b - x.n)) GROUP BY x.conv_id, x.i, x.b),
e AS (SELECT s.conv_id, s.i, s.s, greatest(s.i, coalesce(max(y.i), 0)) AS j
      FROM s LEFT JOIN o y ON y.conv_id = s.conv_id AND y.i >= s.i AND y.p - s.before <= s.b GROUP BY s.conv_id, s.i, s.s),
w AS (SELECT conv_id, 0 AS win, i, s, j FROM e WHERE i = 1
      UNION ALL SELECT e.conv_id, w.win + 1, e.i, e.s, e.j FROM w JOIN e ON e.conv_id = w.conv_id AND e.i = w.j + 1)
SELECT w.conv_id, CAST(win AS BIGINT) AS "window",
       max(CASE WHEN o.i = w.i THEN turn END) AS first_turn, max(CASE WHEN o.i = w.j THEN turn END) AS last_turn,
       w.i - w.s AS n_history, w.j - w.i + 1 AS n_turns, CAST(max(hn) + sum(n) AS BIGINT) AS n_tokens,
       CAST(coalesce(sum(n) FILTER (WHERE o.i >= w.i AND role = 'assistant'), 0) AS BIGINT) AS n_targets,
       CASE WHEN max(lead) IS NULL THEN '' ELSE '0' END || string_agg(CASE WHEN o.i >= w.i AND role = 'assistant' THEN '1' ELSE '0' END, '' ORDER BY o.i) AS targets,
       max(hn) + sum(n) > {BUDGET} AS "over",
       coalesce(max(lead), '') || string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY o.i) AS text
FROM w JOIN o ON o.conv_id = w.conv_id AND o.i BETWEEN w.s AND w.j
GROUP BY w.conv_id, win, w.i, w.s, w.j
"""
