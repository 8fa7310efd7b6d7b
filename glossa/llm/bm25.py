"""Exact BM25 top-k by block-max WAND over sharded inverted indexes.

Pass 1 reads every document once and keeps, for the terms that any query has, (term, frequency) lists beside the length; this table is
written to the shared folder. Document frequencies, count and mean length are summed over it, so all
shards score with the same global statistics. Pass 2 turns each shard into posting lists with the maximum impact
of each block of BLOCK documents. A query adds up its terms' block maxima; blocks are visited from the largest
bound on, and those whose bound is below the k-th best score so far are skipped. In the blocks that remain terms go
from the strongest to the weakest, and a document whose score with all bounds of the terms to come can't reach the k-th best
is no longer followed: only blocks that still have a live document are read on (the pivot rule). Shards give their k best, and the
k best of these are exact.

Every row of queries is a query. Queries are broadcast in groups of at most QUERY_BYTES; further groups are further passes.

Score: sum over the query's distinct terms of qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), idf = ln(1 + (N - df + 0.5) / (df + 0.5)),
rounded to 6 digits; equal scores go by the least id.

Edge cases: queries and documents with a null id or a null text are left out (an empty text counts as a document of
length 0). Rows of queries that repeat an id are one query of all their texts, each rows' once; rows of documents that repeat an id compete each
for itself. Only documents that share a term are listed. Other columns are not read. Empty tables give an empty
result. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import WORD, cut, lean

TOP, K1, B = 10, 1.2, 0.75
BLOCK, SHARD_POSTINGS, QUERY_BYTES = 64, 3_000_000, 8_000_000
_TIE = 1e-6


def _postings(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = terms.value.get
        for b in batches:
            length, ts, fs, n = [], [], [], [0]
            for t in b.column(1):
                words = WORD.findall(t.as_py().lower())
                c = Counter(map(get, words))
                c.pop(None, None)
                length.append(len(words))
                ts.append(np.fromiter(c.keys(), np.int32, len(c)))
                fs.append(np.fromiter(c.values(), np.int32, len(c)))
                n.append(len(c))
            offsets = pa.array(np.cumsum(n).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (ts, fs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(length, pa.int64()), *lists], ["d", "n", "terms", "tfs"])

    return run


class Shard:
    """Posting lists with block maxima; impacts have the idf in them."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, per_doc: np.ndarray, terms: np.ndarray, tfs: np.ndarray, idf: np.ndarray, mean: float, k1: float, b: float):
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), per_doc)
        order = np.argsort(terms, kind="stable")
        term, self.doc = terms[order], doc[order]
        tf = tfs[order].astype(float)
        self.impact = idf[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * n[self.doc] / mean))
        block = self.doc // BLOCK
        self.start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.end = np.r_[self.start[1:], len(term)].astype(np.int64)
        self.block = block[self.start]
        self.most = np.maximum.reduceat(self.impact, self.start) if len(term) else np.zeros(0)
        edge = np.searchsorted(term[self.start], np.arange(len(idf) + 1))
        self.first, self.last = edge[:-1], edge[1:]
        self.blocks = -(-len(ids) // BLOCK)

    def top(self, terms: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for (term, count in the query)."""
        own = [(t, c) for t, c in terms if self.first[t] < self.last[t]]
        bound = np.zeros(self.blocks)
        for t, c in own:
            r = slice(self.first[t], self.last[t])
            bound[self.block[r]] += c * self.most[r]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, scores, least = np.zeros(0, np.int64), np.zeros(0), -np.inf
        at, step = 0, 4
        while at < len(order):
            some = order[at : at + step]
            at, step = at + step, step * 4
            some = some[bound[some] >= least - _TIE]
            if not len(some):
                break
            doc, score = self._score(some, own, least)
            ids, scores = np.r_[ids, self.ids[doc]], np.r_[scores, np.round(score, 6)]
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
            if len(ids) == k:
                least = scores[-1]
        return ids, scores

    def _score(self, some: np.ndarray, own: list[tuple[int, int]], least: float) -> tuple[np.ndarray, np.ndarray]:
        slot = np.full(self.blocks, -1)
        slot[some] = np.arange(len(some))
        found = []
        for t, c in own:
            e = np.arange(self.first[t], self.last[t])
            e = e[slot[self.block[e]] >= 0]
            if len(e):
                found.append((c * float(self.most[e].max()), t, c, e))
        found.sort(key=lambda x: (-x[0], x[1]))
        rest = np.cumsum([x[0] for x in found][::-1])[::-1]
        acc = np.zeros(len(some) * BLOCK)
        parts, live = [], np.ones(len(some), bool)
        for i, (_, t, c, e) in enumerate(found):
            if i and least > -np.inf and i % 4 == 0:
                # documents met so far go on if they can still get there; those not met yet only while the rest alone can
                if rest[i] < least - _TIE:
                    live = ((acc > 0) & (acc + rest[i] >= least - _TIE)).reshape(-1, BLOCK).any(1)
                    if not live.any():
                        return np.zeros(0, np.int64), np.zeros(0)
            e = e[live[slot[self.block[e]]]]
            if not len(e):
                continue
            size = self.end[e] - self.start[e]
            stop = np.cumsum(size)
            p = np.repeat(self.start[e] - (stop - size), size) + np.arange(stop[-1])
            where = slot[self.block[e]].repeat(size) * BLOCK + self.doc[p] % BLOCK
            acc[where] += c * self.impact[p]
            parts.append((t, where, c * self.impact[p]))
        near = np.flatnonzero((acc > 0) & (acc >= least - 2 * _TIE) & np.repeat(live, BLOCK))
        exact = np.zeros(len(acc))
        for _, where, x in sorted(parts, key=lambda x: x[0]):  # one order of addition everywhere
            exact[where] += x
        return some[near // BLOCK] * BLOCK + near % BLOCK, exact[near]


def _search(given, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, idf, mean, k1, b = given.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = [t.column(c).chunk(0) for c in ("terms", "tfs")]
            per_doc = np.diff(lists[0].offsets.to_numpy())
            s = Shard(t.column("d").to_numpy(), t.column("n").to_numpy(), per_doc, *(x.flatten().to_numpy() for x in lists), idf, mean, k1, b)
            out = [(q, *s.top(terms, k)) for q, terms in queries]
            q = np.repeat(np.array([x[0] for x in out], np.int64), [len(x[1]) for x in out])
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], ["q", "d", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column(2).flatten())
            if size >= SHARD_POSTINGS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def search(queries: DataFrame, docs: DataFrame, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", top: int = TOP, k1: float = K1, b: float = B) -> DataFrame:
    """(item_id, rank, doc_id, score): for each query the top documents."""
    spark = docs.sparkSession
    q = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(query_text).cast("string").alias("t")).where("q is not null and t is not null")
    size = q.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    groups = max(1, -(-size // QUERY_BYTES))
    whole = q.groupBy("q").agg(F.array_join(F.sort_array(F.collect_set("t")), " ").alias("t"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t")).where("d is not null and t is not null")
    found = None
    for g in range(groups):
        part = whole if groups == 1 else whole.where(F.pmod(F.xxhash64("q"), F.lit(groups)) == g)
        words = {r.q: Counter(WORD.findall(r.t.lower())) for r in part.collect()}  # bounded by QUERY_BYTES
        terms = {w: i for i, w in enumerate(sorted({w for c in words.values() for w in c}))}
        index = cut(texts.mapInArrow(lean(_postings(spark.sparkContext.broadcast(terms))), "d bigint, n bigint, terms array<int>, tfs array<int>"))
        count, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms))
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a query term
            df[r.t] = r["count"]
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        given = [(i, sorted((terms[w], n) for w, n in c.items())) for i, c in sorted(words.items()) if c]
        if not given or not total:
            continue
        one = index.mapInArrow(lean(_search(spark.sparkContext.broadcast((given, idf, total / count, k1, b)), top)), "q bigint, d bigint, score double")
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = spark.createDataFrame([], "q bigint, d bigint, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top).select(F.col("q").alias("item_id"), "rank", F.col("d").alias("doc_id"), "score")


SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dw),
qt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
qc AS (SELECT item_id, term, count(*) AS qtf FROM qt GROUP BY item_id, term),
dt AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM dw),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qc) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, doc_id, round(sum(qtf * ln(1 + (g.n - df + 0.5) / (df + 0.5)) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * dl / g.mean))), 6) AS score
       FROM qc JOIN tf USING (term) JOIN df USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc)
SELECT * FROM r WHERE rank <= {TOP}
"""
