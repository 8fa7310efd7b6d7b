"""SimHash near-dedup with a Gray-order hierarchical index.

Each document gets two 64-bit SimHashes: one of its words, each weighted by the root
of its count, which is searched, and one of its word pairs, which verifies. All pairs of word fingerprints that differ in at most ``k`` bits are found, and a
pair counts as near-duplicate when its second fingerprints differ in at most ``verify`` bits. Groups are
the connected components of these pairs.

The join loses nothing. The 64 bits are cut into two halves of BLOCKS blocks; two fingerprints that differ in at most k < 10 bits have a half with at
most four differences, and so agree on four of its blocks. Of any four blocks two lie in one of three sets of blocks, so a fingerprint is sent to one bucket for each pair of blocks of
a set: 14 buckets, of 8 bits. (Beyond MANY fingerprints it is sent to one for each four blocks: 140 buckets, of 16 bits.) Within its buckets a task goes through pairs of further blocks; each four blocks come in one bucket only.
For each it sorts the fingerprints by these blocks and by Gray rank; neighbours are put into nodes of 8, these into nodes of 64;
a node keeps the bits that all below it share. Pairs of nodes are descended together: the differences
of bits that both share are added up on the way down, each bit once, and a pair of nodes goes as soon as its
sum exceeds k. As groups are wanted, not pairs, a pair of nodes goes too if all rows below both are already in one group; neighbours are joined first.

Edge cases: a null text, an empty one or one without words has no fingerprint and forms its own group. Equal
fingerprints (copies) are folded before the search. Rows without an id are left out of the result of ``near_duplicates`` and are kept by
``deduplicate``. Rows that repeat an id with one text are one document; with different texts each text has its own group, no group is joined through the id, and
``near_duplicates`` gives a row for each (id, group). ``deduplicate`` keeps one row of a group: that of the least id; of several of this id that with the least hash of its text, then of
all its columns. Other columns, of whatever name, pass through ``deduplicate`` untouched. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import all_word_hashes, components, cut, fresh, lean, mix64, shingle_hashes, word_hashes

K = 9
VERIFY = 15
BLOCKS = 8
MANY = 1 << 27
_LEAF, _TOP = 8, 64
_FRONT, _ROWS = 2_000_000, 100_000


def _sign(h: np.ndarray, weight: np.ndarray) -> int:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * (weight @ bits) > weight.sum()).view(np.int64)[0])


def fingerprint(text: str | None) -> tuple[int, int] | None:
    """The two SimHashes of a text; None if it has no words."""
    return _fingerprint(word_hashes(text)) if text else None


def _fingerprint(words: np.ndarray) -> tuple[int, int] | None:
    if not len(words):
        return None
    word, n = np.unique(words, return_counts=True)
    pairs = shingle_hashes(words, 2)
    return _sign(mix64(word), np.sqrt(n)), _sign(pairs, np.ones(len(pairs)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_fingerprint(w) or (None, None) for w in all_word_hashes([t or "" for t in b.column(1).to_pylist()])]
        one, two = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["id", "h", "f", "g"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, f, g) for each row that has an id: h is a hash of the text, f and g are null without words."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("t"), F.xxhash64(text).alias("h")).where("id is not null").mapInArrow(lean(_fingerprints), "id bigint, h bigint, f bigint, g bigint")


def tables(many: bool) -> list[tuple[int, list[int]]]:
    """For each bucket of a fingerprint the mask of the bits that its key has, and the masks of the keys of the sorts within it."""
    width = 32 // BLOCKS
    out = []
    for half in (0, 32):
        def mask(blocks: tuple[int, ...]) -> int:
            return sum(((1 << width) - 1) << half + width * b for b in blocks)

        if many:
            out += [(mask(x), [0]) for x in combinations(range(BLOCKS), 4)]
        else:
            sets = [range(0, 3), range(3, 6), range(6, BLOCKS)]
            sorts = {x: [] for s in sets for x in combinations(s, 2)}
            for four in combinations(range(BLOCKS), 4):  # each in one bucket, that of the fewest sorts so far
                x = min((x for x in sorts if set(x) <= set(four)), key=lambda x: len(sorts[x]))
                sorts[x].append(mask(tuple(b for b in four if b not in x)))
            out += [(mask(x), ys) for x, ys in sorts.items()]
    return out


def gray_rank(f: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    r = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _triangle(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For groups of n members: the group, first and second member of each unordered pair, also of equal ones."""
    group = np.repeat(np.arange(len(n)), n)
    a = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    m = n[group] - a
    b = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    return np.repeat(group, m), np.repeat(a, m), b + np.repeat(a, m)


def _nodes(f: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared bits (mask, pattern) of the runs that begin at starts."""
    low, high = np.bitwise_and.reduceat(f, starts), np.bitwise_or.reduceat(f, starts)
    return ~(low ^ high), low


def _split(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts the runs [start, end) into pieces of size; the starts, and how many each run has."""
    n = -(-(ends - starts) // size)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts, n) + k * size, n


def _descend(a, b, acc, seen, up, down, count, first, k):
    """Replaces each pair of nodes by the pairs of their children whose accumulated difference is at most k."""
    ca, cb = count[a], count[b]
    n = ca * cb
    pair = np.repeat(np.arange(len(a)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, y = first[a][pair] + at // cb[pair], first[b][pair] + at % cb[pair]
    keep = x <= y
    pair, x, y = pair[keep], x[keep], y[keep]
    both = down[0][x] & down[0][y]
    acc = acc[pair] + np.bitwise_count((down[1][x] ^ down[1][y]) & both & ~seen[pair]).astype(np.int16)
    keep = acc <= k
    return x[keep], y[keep], acc[keep], both[keep]


def _one_group(group: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The group of each run that begins at starts if it has one, else -1."""
    low = np.minimum.reduceat(group, starts)
    return np.where(low == np.maximum.reduceat(group, starts), low, -1)


def close_pairs(keys: np.ndarray, f: np.ndarray, k: int, join=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one key whose f differ in at most k bits: yields (i, j).

    join, if given, takes pairs of neighbours and gives the group of each row; pairs within a group may then be left out.
    """
    order = np.lexsort((gray_rank(f), keys))
    keys, f = keys[order], f[order]
    alone = np.r_[True, keys[1:] != keys[:-1]] & np.r_[keys[1:] != keys[:-1], True] if len(keys) else np.zeros(0, bool)
    order, keys, f = order[~alone], keys[~alone], f[~alone]
    if not len(keys):
        return
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    end = np.r_[begin[1:], len(keys)].astype(np.int64)
    tops, n_top = _split(begin, end, _TOP)
    top_end = np.minimum(tops + _TOP, np.repeat(end, n_top))
    leaves, n_leaf = _split(tops, top_end, _LEAF)
    leaf_end = np.minimum(leaves + _LEAF, np.repeat(top_end, n_leaf))
    top, leaf, row = _nodes(f, tops), _nodes(f, leaves), (np.full(len(f), ~np.uint64(0)), f)
    if join:
        near = np.flatnonzero((keys[1:] == keys[:-1]) & (np.bitwise_count(f[1:] ^ f[:-1]) <= k))
        group = join(order[near], order[near + 1])[order]
        own = _one_group(group, tops), _one_group(group, leaves), group
    else:
        own = np.arange(len(tops)), np.arange(len(leaves)), np.arange(len(f))
        own = tuple(-1 - x for x in own)
    first_top, first_leaf = np.cumsum(n_top) - n_top, np.cumsum(n_leaf) - n_leaf
    todo = np.cumsum(n_top * (n_top + 1) // 2)
    step = 0
    while step < len(n_top):  # as many buckets at once as give a bounded number of pairs of upper nodes
        base = todo[step - 1] if step else 0
        upto = max(step + 1, int(np.searchsorted(todo, base + _FRONT)))
        for a, b in _bounded_triangles(n_top[step:upto], first_top[step:upto]):
            both = top[0][a] & top[0][b]
            acc = np.bitwise_count((top[1][a] ^ top[1][b]) & both).astype(np.int16)
            keep = (acc <= k) & ((own[0][a] < 0) | (own[0][a] != own[0][b]))
            a, b, acc, both = a[keep], b[keep], acc[keep], both[keep]
            for s in range(0, len(a), _FRONT // 64):
                t = slice(s, s + _FRONT // 64)
                x, y, ac, bo = _descend(a[t], b[t], acc[t], both[t], top, leaf, n_leaf, first_leaf, k)
                keep = (own[1][x] < 0) | (own[1][x] != own[1][y])
                x, y, ac, bo = x[keep], y[keep], ac[keep], bo[keep]
                for s2 in range(0, len(x), _FRONT // 64):
                    t2 = slice(s2, s2 + _FRONT // 64)
                    i, j, _, _ = _descend(x[t2], y[t2], ac[t2], bo[t2], leaf, row, leaf_end - leaves, leaves, k)
                    off = (i < j) & ((own[2][i] < 0) | (own[2][i] != own[2][j]))
                    if off.any():
                        yield order[i[off]], order[j[off]]
        step = upto


def _bounded_triangles(n: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of upper nodes of some buckets; those of a single large one by a few nodes at a time."""
    if len(n) > 1 or n[0] * (n[0] + 1) // 2 <= _FRONT:
        group, a, b = _triangle(n)
        yield a + first[group], b + first[group]
        return
    step = max(1, _FRONT // int(n[0]))
    for x in range(0, int(n[0]), step):
        m = n[0] - np.arange(x, min(x + step, n[0]))
        a = np.repeat(np.arange(x, x + len(m)), m)
        yield a + first[0], a + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + first[0]


class _Union:
    """Components of the rows 0..n-1, led by their least row; takes pairs by the array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def join(self, x: np.ndarray, y: np.ndarray, step: int = 65536) -> None:
        for s in range(0, len(x), step):
            p = self.roots()
            a, b = p[x[s : s + step]], p[y[s : s + step]]
            while (m := a != b).any():
                a, b = a[m], b[m]
                high, low = np.maximum(a, b), np.minimum(a, b)
                self.parent[high] = low  # one of the pairs with this root wins; the others go round again
                p = self.roots()
                a, b = p[high], p[low]


def _search(k: int, verify: int, masks: list[tuple[int, list[int]]]):
    """Of rows (table, key, f, g, node) sorted by table and key: (a, b), each row's node and the least of its group. Keys go on over batches."""

    def groups(table: int, key: np.ndarray, f: np.ndarray, g: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        f, g = f.view(np.uint64), g.view(np.uint64)
        union = _Union(len(node))

        def join(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = np.bitwise_count(g[i] ^ g[j]) <= verify
            union.join(i[ok], j[ok])
            return union.roots()

        for mask in masks[table][1]:
            for i, j in close_pairs(mix64(f & np.uint64(mask) | np.uint64(1 << 63) & ~np.uint64(mask)) ^ key.view(np.uint64), f, k, join):
                join(i, j)
        root = union.roots()
        low = root != np.arange(len(node))
        return pa.RecordBatch.from_arrays([pa.array(node[low]), pa.array(node[root[low]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) >= _ROWS:  # all but the last key, which may go on; if it is the only one, wait
                last = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1] + 1) if ((held[0] != held[0][-1]) | (held[1] != held[1][-1])).any() else 0
                yield from parts([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held is not None:
            yield from parts(held)

    def parts(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        table = cols[0]
        edge = np.r_[0, np.flatnonzero(table[1:] != table[:-1]) + 1, len(table)] if len(table) else [0]
        for x, y in zip(edge, edge[1:]):
            yield groups(int(table[x]), *(c[x:y] for c in cols[1:]))

    return run


def _grouped(docs: DataFrame, id_col: str, text_col: str, k: int, verify: int) -> DataFrame:
    """(id, h, root, group_id) for each row that has an id: root is the group's own number, null without words."""
    if not 0 <= k < 10:
        raise ValueError("k must lie in [0, 9]: the buckets promise no more")
    prints = cut(fingerprints(docs, id_col, text_col))
    node = F.xxhash64("f", "g").alias("node")
    heads = cut(prints.where("f is not null").groupBy("f", "g").agg(F.min("id").alias("head")).select("f", "g", node, "head"))
    masks = tables(heads.count() > MANY)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m, _ in masks]
    bucket = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.xxhash64(F.col("f").bitwiseAND(F.lit(m))).alias("key")) for i, m in enumerate(signed)])).alias("e")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = heads.select(bucket, "f", "g", "node").select("e.t", "e.key", "f", "g", "node")
    found = rows.repartition(parts, "t", "key").sortWithinPartitions("t", "key").mapInArrow(lean(_search(k, verify, masks)), "a bigint, b bigint")
    groups = components(found)
    least = groups.join(heads, "node").groupBy("root").agg(F.min("head").alias("label"))
    of_node = heads.select("node", "head").join(groups.join(least, "root").select("node", "root", "label"), "node", "left").select(F.col("node").alias("n"), F.coalesce("root", "node").alias("root"), F.coalesce("label", "head").alias("label"))
    out = prints.withColumn("node", F.when(F.col("f").isNotNull(), F.xxhash64("f", "g")))
    return out.join(of_node, out.node == of_node.n, "left").select("id", "h", "root", F.coalesce("label", "id").alias("group_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, verify: int = VERIFY) -> DataFrame:
    """(doc_id, group_id, keep) for each distinct id: the least id of its group, and whether it is that one."""
    rows = _grouped(docs, id_col, text_col, k, verify).select(F.col("id").alias("doc_id"), "group_id").distinct()
    return rows.withColumn("keep", F.col("doc_id") == F.col("group_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, verify: int = VERIFY) -> DataFrame:
    """docs with one row for each group: that of the least id. Rows without an id stay. Texts of ids that come once are not shuffled by this function's own doing."""
    rows = cut(_grouped(docs, id_col, text_col, k, verify))
    many = cut(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    gone = rows.where("id <> group_id").select("id").unionAll(many).distinct().select(F.col("id").alias(id_col))
    once = docs.join(gone, id_col, "left_anti").select(*docs.columns)
    if many.isEmpty():
        return once
    # rows of an id that comes more than once: of each group that the id leads, one
    i, h, order = (fresh(docs, x) for x in ("i", "h", "order"))
    stay = rows.where("id = group_id").join(many, "id", "left_semi").groupBy("id", "root").agg(F.min("h").alias(h)).select(F.col("id").alias(i), h)
    known = [F.col(c) for c, t in docs.dtypes if "map<" not in t]
    more = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string"))).withColumn(i, F.col(id_col).cast("bigint")).join(stay, [i, h]).withColumn(order, F.xxhash64(*known))
    one = more.groupBy(i, h).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return once.unionAll(one)
