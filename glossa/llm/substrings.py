"""Passages that repeat across documents, found by collinear chaining.

1. Seeds: of the K-word shingles of a text, by 32 bits of each word's hash, each window of WINDOW shingles gives its least (a shared run of K + WINDOW - 1
   words always shares a seed). A seed that one document alone has links nothing and isn't shuffled: chunks of documents send their distinct seeds' prints
   of PRINT bits to buckets by the hash, and get a bit back for each, whether another chunk has it. Prints that agree by chance let a seed through in vain; none is lost.
2. Join: the seeds that are left are shuffled by their hash and sorted; each occurrence is linked to the document of least id that has the seed: to its occurrence
   of the same rank, and to its first. Links are at most twice as many as occurrences, however many documents share a passage: no pairs among the sharers are made, and none are
   dropped, as all of them meet at the first document.
3. Chains: links of a pair of documents that follow one another on a diagonal are segments; segments are chained in
   order in both documents, where a gap costs GAP_COST a word on either side. With that cost the best predecessor is a
   prefix maximum, kept in a Fenwick tree.
4. Alignment: chains fetch the word codes around them, gaps are aligned by longest common subsequence and ends are extended
   until mismatches outweigh matches, where they weigh as little as the identity allows. A chain with at least ``identity`` matching words is a fuzzy repeat.
5. Repeats of a document that overlap or touch are one passage, which counts if it has ``min_words`` words.

Edge cases: a null text, an empty one or one of fewer than K words has no seeds and no passages. Rows without an id are
never matched and stay. Rows that repeat an id count as one document, of which the least word sequence is aligned; ``remove``
changes only rows with that sequence. Of equal documents the least id is kept whole. Texts are used whole,
whatever their length. Other columns, of whatever name, pass through ``remove``. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import WORD, all_word_hashes, cut, fresh, lean, shingle_hashes

K, WINDOW = 6, 1
MIN_WORDS, IDENTITY = 50, 0.75
GAP_COST, MAX_GAP, LEAST_SPAN = 0.25, 40, 8
_SLACK, _EDGE = 6, 64
PRINT = 28
_CHUNK_WORDS, _BUCKET_WORDS = 1 << 20, 1 << 22
_COSTS = (1, 2, 3)  # of a mismatch, in matches, where ends are extended


def _minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the least (leftmost) of each window of hashes."""
    if len(h) <= window:
        return np.array([h.argmin()]) if len(h) else np.zeros(0, np.int64)
    at = np.lib.stride_tricks.sliding_window_view(h, window).argmin(1) + np.arange(len(h) - window + 1)
    return at[np.r_[True, at[1:] != at[:-1]]]


def _planes(x: np.ndarray) -> bytes:
    """Numbers of four bytes, compressed: the first byte of all, then the second of all, and so on."""
    return pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, codes) by the chunk: its number, its documents, how many words each has, the different codes, most frequent first, and the place of each word's among them."""
    held: list[tuple[int, bytes]] = []
    number, words = TaskContext.get().partitionId() << 32, 0

    def row() -> pa.RecordBatch:
        ds, codes = zip(*held)
        vocab, at, count = np.unique(np.frombuffer(b"".join(codes), "<u4"), return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ds], pa.list_(pa.int64())), pa.array([[len(c) // 4 for c in codes]], pa.list_(pa.int32())), pa.array([vocab[order].tobytes()], pa.binary()), pa.array([_planes(place[at])], pa.binary())], ["chunk", "d", "n", "vocab", "data"])

    for b in batches:
        for d, codes in zip(b.column(0).to_pylist(), b.column(1)):
            held.append((d, codes.as_py()))
            words += len(held[-1][1]) // 4
            if words >= _CHUNK_WORDS:
                yield row()
                held, words, number = [], 0, number + 1
    if held:
        yield row()


def _words(n: np.ndarray, vocab: bytes, data: bytes) -> np.ndarray:
    """The codes of a chunk's words, of which its documents have n."""
    return np.frombuffer(vocab, "<u4")[_unplanes(data, int(n.sum()))]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks by the document again: (d, codes) with two bytes for each word."""
    for b in batches:
        for d, n, vocab, data in zip(*(b.column(c) for c in ("d", "n", "vocab", "data"))):
            codes = (_words(n.values.to_numpy(), vocab.as_py(), data.as_py()) >> np.uint32(16)).astype("<u2").tobytes()
            end = np.cumsum(n.values.to_numpy(), dtype=np.int64) * 2
            yield pa.RecordBatch.from_arrays([d.values, pa.array([codes[x:y] for x, y in zip(np.r_[0, end], end)], pa.binary())], ["d", "codes"])


def _seeds(n: np.ndarray, words: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's documents of n words: (hash, document, place) of each seed, in order."""
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, owner, begin = shingle_hashes(words.astype(np.uint64), k), np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    if window == 1:
        at = np.flatnonzero(owner[: len(h)] == owner[k - 1 :])
    else:
        at = np.concatenate([x + _minimizers(h[x : x + m - k + 1], window) for x, m in zip(begin, n) if m >= k] or [np.zeros(0, np.int64)])
    return h[at], owner[at], at - begin[owner[at]]


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and print of each hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(PRINT) | h & np.uint64((1 << PRINT) - 1)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets begin and end in ascending keys."""
    return np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(PRINT))


def _pack(prints: np.ndarray) -> bytes:
    """Ascending prints as differences."""
    return _planes(np.diff(prints, prepend=np.uint32(0)))


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unplanes(data, n), dtype=np.uint32)


def _prints(k: int, window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, n, vocab, data in zip(*(b.column(c) for c in ("chunk", "n", "vocab", "data"))):
                keys = np.sort(_keys(_seeds(n.values.to_numpy(), _words(n.values.to_numpy(), vocab.as_py(), data.as_py()), k, window)[0], buckets))
                keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
                edge, low = _edges(keys, buckets), (keys & np.uint64((1 << PRINT) - 1)).astype(np.uint32)
                some = np.flatnonzero(np.diff(edge))
                packed = [_pack(low[x:y]) for x, y in zip(edge[some], edge[some + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk.as_py())), pa.array(np.diff(edge)[some].astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "chunk", "n", "data"])

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of prints sorted by bucket: for those of each chunk a bit, whether another chunk has them too; chunks without one have no row."""

    def answer(bucket: int, chunks: list[int], blocks: list[np.ndarray]) -> pa.RecordBatch:
        v = np.sort(np.concatenate(blocks))
        twice = v[1:][v[1:] == v[:-1]]
        rows = []
        if len(twice):
            for chunk, own in zip(chunks, blocks):
                bits = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
                if bits.any():
                    rows.append((chunk, np.packbits(bits).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "bucket", "data"])

    bucket, chunks, blocks = None, [], []
    for b in batches:
        for new, chunk, n, data in zip(*(b.column(c) for c in ("bucket", "chunk", "n", "data"))):
            if new.as_py() != bucket:
                if blocks:
                    yield answer(bucket, chunks, blocks)
                bucket, chunks, blocks = new.as_py(), [], []
            chunks.append(chunk.as_py())
            blocks.append(_unpack(data.as_py(), n.as_py()))
    if blocks:
        yield answer(bucket, chunks, blocks)


def _shared(k: int, window: int, buckets: int):
    """Of chunks, each before its answers: the seeds that another chunk or another document of the chunk has."""

    def seeds(ds: np.ndarray, n: np.ndarray, words: np.ndarray, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        h, owner, p = _seeds(n, words, k, window)
        keys, of = np.unique(_keys(h, buckets), return_inverse=True)
        edge = _edges(keys, buckets)
        first, last = np.full(len(keys), len(n)), np.full(len(keys), -1)
        first[of[::-1]], last[of] = owner[::-1], owner  # the last of several that are put to one place stays; owners ascend
        wanted = first != last
        for bucket, bits in answers:
            x, y = edge[bucket], edge[bucket + 1]
            wanted[x:y] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
        keep = wanted[of]
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(ds[owner[keep]]), pa.array(p[keep].astype(np.int32))], ["h", "d", "p"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = None, []
        for b in batches:
            for bucket, d, n, vocab, data in zip(*(b.column(c) for c in ("bucket", "d", "n", "vocab", "data"))):
                if bucket.as_py() >= 0:
                    answers.append((bucket.as_py(), data.as_py()))
                    continue
                if held:
                    yield seeds(*held, answers)
                held, answers = (d.values.to_numpy(), n.values.to_numpy(), _words(n.values.to_numpy(), vocab.as_py(), data.as_py())), []
        if held:
            yield seeds(*held, answers)

    return run


def shared_seeds(chunks: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(h, d, p) of the seeds of chunks (a table that reads the same each time) that several documents have."""
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = chunks.agg(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda x, y: x + y))).first()[0] or 0
    buckets = max(parts, -(-words // _BUCKET_WORDS))
    prints = chunks.mapInArrow(lean(_prints(k, window, buckets)), "bucket int, chunk bigint, n int, data binary")
    answers = prints.repartition(parts, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(lean(_answers), "chunk bigint, bucket int, data binary")
    none = "cast(null as {}) {}".format
    both = chunks.selectExpr("chunk", "-1 as bucket", "d", "n", "vocab", "data").unionAll(answers.selectExpr("chunk", "bucket", none("array<bigint>", "d"), none("array<int>", "n"), none("binary", "vocab"), "data"))
    return both.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(lean(_shared(k, window, buckets)), "h bigint, d bigint, p int")


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four bytes for each word; the upper two are those of _code."""
    for b in batches:
        out = [(h >> np.uint64(32)).astype("<u4").tobytes() for h in all_word_hashes(b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["d", "codes"])


def _code(words: np.ndarray) -> bytes:
    """Two bytes for each word, given their hashes."""
    return (words >> np.uint64(48)).astype("<u2").tobytes()


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, d, p): those of other documents than the first of their h, each with that document's occurrence of the same rank (or its last), and with its first.

    A batch that goes on with the h of the one before is led by that h's occurrences in the first document and in the one that was cut.
    """
    lead = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(cols[0]):
            continue
        skip = 0
        if lead is not None and lead[0][0] == cols[0][0]:
            skip = len(lead[0])
            cols = [np.concatenate(x) for x in zip(lead, cols)]
        h, d, p = cols
        at = np.arange(len(h))
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_d = new_h | np.r_[True, d[1:] != d[:-1]]
        first, own = np.maximum.accumulate(np.where(new_h, at, 0)), np.maximum.accumulate(np.where(new_d, at, 0))
        size = np.diff(np.r_[np.flatnonzero(new_d), len(h)])[(np.cumsum(new_d) - 1)[first]]  # how often the first document has this h
        same = first + np.minimum(at - own, size - 1)
        other = d != d[first]
        lead = [np.concatenate([c[first[-1] : first[-1] + size[-1]], c[own[-1] :] if other[-1] else c[:0]]) for c in cols]
        other[:skip] = False
        x = np.flatnonzero(other)
        y = x[same[x] != first[x]]
        x, src = np.r_[x, y], np.r_[same[x], first[y]]
        q, to = p[src].astype(np.int32), p[x].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (d[x], d[src], to - q, to)], ["d", "r", "g", "p"])


class Fenwick:
    """Prefix maxima with the item that has them."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, n: int) -> tuple[float, int]:
        """Over the first n places."""
        best = self.best[0]
        while n:
            best = max(best, self.best[n])
            n -= n & -n
        return best


def chain(segments: list[tuple[int, int, int, int]], gap_cost: float = GAP_COST, slack: int = _SLACK, max_gap: int = MAX_GAP) -> list[list[tuple[int, int, int, int]]]:
    """Disjoint chains of segments (x0, x1, y0, y1), best first; each chain is ascending in x and y and has no gap above max_gap."""
    segments = sorted(segments)
    ends = sorted({s[3] for s in segments})
    tree, score, before = Fenwick(len(ends)), [0.0] * len(segments), [-1] * len(segments)
    by_end = sorted(range(len(segments)), key=lambda i: (segments[i][1], i))
    entered = 0
    for i, (x0, x1, y0, _) in enumerate(segments):
        held = []
        while entered < len(by_end) and segments[by_end[entered]][1] <= x0 + slack:
            j = by_end[entered]
            if j >= i:  # not scored yet: of a segment shorter than the slack
                held.append(j)
            else:
                s = segments[j]
                tree.put(bisect_left(ends, s[3]), (score[j] + gap_cost * (s[1] + s[3]), j))
            entered += 1
        if held:
            by_end[entered - len(held) : entered] = held
            entered -= len(held)
        best, j = tree.upto(bisect_right(ends, y0 + slack))
        gain = best - gap_cost * (x0 + y0)
        score[i] = x1 - x0 + max(0.0, gain)
        before[i] = j if gain > 0 else -1
    used, out = [False] * len(segments), []
    for i in sorted(range(len(segments)), key=lambda i: (-score[i], i)):
        part: list[tuple[int, int, int, int]] = []
        while i >= 0 and not used[i]:
            used[i] = True
            s = segments[i]
            if part and (part[-1][0] - s[1] > max_gap or part[-1][2] - s[3] > max_gap):
                out.append(part[::-1])
                part = []
            part.append(s)
            i = before[i]
        if part:
            out.append(part[::-1])
    return out


def _chains(k: int, window: int, least: int):
    schema = pa.schema([("d", pa.int64()), ("r", pa.int64()), ("segments", pa.list_(pa.int32()))])

    def groups(d, r, g, p) -> pa.RecordBatch:
        new = np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])]
        start = np.flatnonzero(new | np.r_[True, (g[1:] != g[:-1]) | (p[1:] - p[:-1] > window)])
        end = np.r_[start[1:], len(p)] - 1
        x0, x1, diagonal = p[start].astype(np.int64), p[end].astype(np.int64) + k, g[start]
        y0, y1 = x0 - diagonal, x1 - diagonal
        first = np.flatnonzero(new[start])
        size = np.diff(np.r_[first, len(start)])
        ds, rs, flat, lengths = [], [], [], []
        one = first[(size == 1) & (x1[first] - x0[first] >= least)]
        if len(one):
            ds, rs = [d[start[one]]], [r[start[one]]]
            flat, lengths = [np.stack([x0[one], x1[one], y0[one], y1[one]], 1).ravel()], [np.full(len(one), 4)]
        for f, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
            t = slice(f, f + n)
            for c in chain(list(zip(x0[t].tolist(), x1[t].tolist(), y0[t].tolist(), y1[t].tolist()))):
                if c[-1][1] - c[0][0] >= least:
                    ds.append(d[start[f : f + 1]])
                    rs.append(r[start[f : f + 1]])
                    flat.append(np.array(c).ravel())
                    lengths.append(np.array([4 * len(c)]))
        if not ds:
            return pa.RecordBatch.from_pylist([], schema)
        offsets = np.r_[0, np.cumsum(np.concatenate(lengths))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ds)), pa.array(np.concatenate(rs)), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            d, r = cols[0], cols[1]
            change = np.flatnonzero((d[1:] != d[:-1]) | (r[1:] != r[:-1]))
            upto = int(change[-1]) + 1 if len(change) else 0  # the last pair may go on in the next batch
            if upto:
                yield groups(*(c[:upto] for c in cols))
            held = [c[upto:] for c in cols]
        if held is not None:
            yield groups(*held)

    return run


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _reach(same: np.ndarray, cost: int) -> int:
    """How far to go while a match gives 1 and a mismatch takes ``cost``: to the last place up to which matches weigh as much as all else."""
    if not len(same):
        return 0
    s = np.cumsum(np.where(same, 1, -cost))
    i = len(s) - 1 - int(s[::-1].argmax())
    return i + 1 if s[i] >= 0 and same[i] else 0


def align(segments: list[int], a: np.ndarray, a0: int, b: np.ndarray, b0: int, identity: float = IDENTITY) -> tuple[int, int, int, int, int]:
    """(x0, x1, y0, y1, matches) of a chain; a and b are the codes from the places a0 and b0 on. The ends go as far as leaves ``identity``, by the least of _COSTS that does."""
    it = [segments[i : i + 4] for i in range(0, len(segments), 4)]
    matches, x, y = 0, it[0][0], it[0][2]
    for x0, x1, y0, y1 in it:
        skip = max(0, x - x0, y - y0)  # the part that the segment before has had
        x0, y0 = min(x0 + skip, x1), min(y0 + skip, y1)
        if x0 > x or y0 > y:
            matches += lcs(a[x - a0 : x0 - a0].tolist(), b[y - b0 : y0 - b0].tolist())
        s, t = a[x0 - a0 : x1 - a0], b[y0 - b0 : y1 - b0]
        n = min(len(s), len(t))
        matches += int((s[:n] == t[:n]).sum())
        x, y = max(x, x1), max(y, y1)
    for cost in _COSTS:
        found = _extend(it[0][0], x, it[0][2], y, matches, a, a0, b, b0, cost)
        if found[4] >= identity * max(found[1] - found[0], found[3] - found[2]):
            break
    return found


def _extend(x0: int, x: int, y0: int, y: int, matches: int, a: np.ndarray, a0: int, b: np.ndarray, b0: int, cost: int) -> tuple[int, int, int, int, int]:
    while n := min(_EDGE, x0 - a0, y0 - b0):
        same = (a[x0 - a0 - n : x0 - a0] == b[y0 - b0 - n : y0 - b0])[::-1]
        step = _reach(same, cost)
        matches += int(same[:step].sum())
        x0, y0 = x0 - step, y0 - step
        if step < n:
            break
    while (n := min(_EDGE, a0 + len(a) - x, b0 + len(b) - y)) > 0:
        same = a[x - a0 : x - a0 + n] == b[y - b0 : y - b0 + n]
        step = _reach(same, cost)
        matches += int(same[:step].sum())
        x, y = x + step, y + step
        if step < n:
            break
    return x0, x, y0, y, matches


def _align(identity: float):
    names = ["d", "r", "x0", "x1", "y0", "y1", "matches", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, r, seg, a0, a, b0, b, sig in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
                if seg[-3] <= a0 + len(a) and seg[-1] <= b0 + len(b):  # else of a row with this id but another text
                    x0, x1, y0, y1, m = align(seg, a, a0, b, b0, identity)
                    if m >= identity * max(x1 - x0, y1 - y0):
                        rows.append((d, r, x0, x1, y0, y1, m, sig))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [()] * 8)], names)

    return run


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, start_word, end_word, other_id, other_start, other_end, matches, passage_start, passage_end, sig): each repeat of a part of an earlier document.

    Words are numbered from 0, ends are exclusive; matches is the number of words aligned to equal ones. passage_start and passage_end bound the passage
    that the repeat is a part of; sig is the CRC-32 of the document's word codes.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).cast("string").alias("t")).where("d is not null and t is not null")
    least = texts.mapInArrow(lean(_codes), "d bigint, codes binary").groupBy("d").agg(F.min("codes").alias("codes"))
    chunks = cut(least.mapInArrow(lean(_chunks), "chunk bigint, d array<bigint>, n array<int>, vocab binary, data binary"))
    links = shared_seeds(chunks, k, window).repartition(parts, "h").sortWithinPartitions("h", "d", "p").mapInArrow(lean(_link), "d bigint, r bigint, g int, p int")
    chains = cut(links.repartition(parts, "d").sortWithinPartitions("d", "r", "g", "p").mapInArrow(lean(_chains(k, window, LEAST_SPAN)), "d bigint, r bigint, segments array<int>"))
    codes = chunks.mapInArrow(lean(_rows), "d bigint, codes binary")

    def around(first: str, last: str) -> tuple[Column, Column]:
        start = F.greatest(F.expr(first) - _EDGE, F.lit(0))
        return start, F.substring("codes", 2 * start + 1, 2 * (F.expr(last) - start + _EDGE))

    a0, a = around("element_at(segments, 1)", "element_at(segments, -3)")
    one = chains.join(codes, "d").select("d", "r", "segments", a0.alias("a0"), a.alias("a"), F.crc32("codes").alias("sig"))
    b0, b = around("element_at(segments, 3)", "element_at(segments, -1)")
    sides = one.join(codes.select(F.col("d").alias("r"), "codes"), "r").select("d", "r", "segments", "a0", "a", b0.alias("b0"), b.alias("b"), "sig")
    found = sides.mapInArrow(lean(_align(identity)), "d bigint, r bigint, x0 bigint, x1 bigint, y0 bigint, y1 bigint, matches bigint, sig bigint")
    by = Window.partitionBy("d").orderBy("x0", "x1", "r", "y0", "y1")
    reach = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("reach", reach).withColumn("island", F.sum((F.col("reach").isNull() | (F.col("x0") > F.col("reach") + 1)).cast("int")).over(by))
    whole = Window.partitionBy("d", "island")
    found = found.withColumn("s", F.min("x0").over(whole)).withColumn("e", F.max("x1").over(whole)).where(F.col("e") - F.col("s") >= min_words)
    names = {"d": "doc_id", "x0": "start_word", "x1": "end_word", "r": "other_id", "y0": "other_start", "y1": "other_end", "matches": "matches", "s": "passage_start", "e": "passage_end", "sig": "sig"}
    return found.select(*[F.col(c).alias(n) for c, n in names.items()])


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the ascending, disjoint spans and what stands after each of these words."""
    starts = [m.start() for m in WORD.finditer(text)]
    starts.append(len(text))
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = starts[min(e, len(starts) - 1)]
    return "".join([*out, text[at:]])


def _cut_all(texts: pd.Series, spans: pd.Series, sigs: pd.Series) -> pd.Series:
    some = [i for i, (t, s) in enumerate(zip(texts, spans)) if t is not None and s is not None]
    out = texts.tolist()
    for i, h in zip(some, all_word_hashes([out[i] for i in some])):
        if zlib.crc32(_code(h)) == sigs.iloc[i]:
            out[i] = cut_words(out[i], [(x["s"], x["e"]) for x in spans.iloc[i]])
    return pd.Series(out, dtype=object)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """docs without the repeated passages; the first document that has a passage keeps it. Rows with nothing left but blanks and punctuation go; length_col, if given, follows the new length."""
    found = passages(docs, id_col, text_col, **options)
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(F.col("passage_start").alias("s"), F.col("passage_end").alias("e")))).alias("spans"), F.min("sig").alias("sig"))
    cut_all = F.pandas_udf(_cut_all, "string")
    key, cuts, sig, new = (fresh(docs, n) for n in ("_id", "_spans", "_sig", "_new"))
    spans = spans.select(F.col("doc_id").alias(key), F.col("spans").alias(cuts), F.col("sig").alias(sig))
    both = docs.join(spans, F.col(id_col).cast("bigint") == F.col(key), "left")
    both = both.withColumn(new, F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(cut_all(F.col(text_col).cast("string"), F.col(cuts), F.col(sig))))
    both = both.where(F.col(cuts).isNull() | F.col(new).rlike(r"(?U)\w"))
    changed = F.col(cuts).isNotNull()
    put = {text_col: F.col(new)} | ({length_col: F.when(changed, F.length(new).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))} if length_col else {})
    return both.select(*[put.get(c, F.col(c)).alias(c) for c in docs.columns])
