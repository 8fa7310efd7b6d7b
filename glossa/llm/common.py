"""Shared helpers: word hashing, lineage cuts, fresh column names."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
_U = np.uint64
_CACHE_MOST = 400_000
_RUN_CHARS = 1 << 19


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_MOST:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = h
        return h


_hashes = _Hashes()


def mix64(h: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finalizer, vectorised."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a whole text."""
    low = text.lower()
    words = WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]  # as WORD cuts the text itself
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


@cache
def _word_chars() -> np.ndarray:
    """Of each code point, whether WORD takes it."""
    out = np.zeros(0x110000, bool)
    for m in WORD.finditer(np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        out[m.start() : m.end()] = True
    return out


_P = [_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turn(h: np.ndarray, n: int) -> np.ndarray:
    return h << _U(n) | h >> _U(64 - n)


def _xxh64(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxHash64 of the slices of data, side by side."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    eight, four = (np.ndarray(len(raw) - w + 1, f"<u{w}", raw, strides=(1,)) for w in (8, 4))
    h = _P[4] + size.astype(np.uint64)
    for i in range(0, 24, 8):
        at = np.flatnonzero(size >= i + 8)
        h[at] = _turn(h[at] ^ _turn(eight[start[at] + i] * _P[1], 31) * _P[0], 27) * _P[0] + _P[3]
    at, rest = np.flatnonzero(size & 4), start + (size & ~7)
    h[at] = _turn(h[at] ^ four[rest[at]].astype(np.uint64) * _P[0], 23) * _P[1] + _P[2]
    rest += size & 4
    for i in range(3):
        at = np.flatnonzero(size & 3 > i)
        h[at] = _turn(h[at] ^ raw[rest[at] + i].astype(np.uint64) * _P[4], 11) * _P[0]
    h ^= h >> _U(33)
    h *= _P[1]
    h ^= h >> _U(29)
    h *= _P[2]
    h ^= h >> _U(32)
    for i in np.flatnonzero(size >= 32):  # these have another form
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]])
    return h


def all_word_hashes(texts: list[str]) -> list[np.ndarray]:
    """word_hashes of each text, many texts at a time."""
    out: list[np.ndarray] = []
    for at, end in _runs([len(t) for t in texts], _RUN_CHARS):
        low = [t.lower() for t in texts[at:end]]
        odd = [i for i, t in enumerate(low) if len(t) != len(texts[at + i])]
        for i in odd:
            low[i] = ""
        joined = "\n".join(low)  # no word goes on from one text to the next
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        place = np.r_[0, np.cumsum(1 + (code > 0x7F).view(np.uint8) + (code > 0x7FF) + (code > 0xFFFF), dtype=np.int64)]
        inside = np.r_[False, _word_chars()[code], False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = place[edge[::2]], place[edge[1::2]] - place[edge[::2]]
        text = np.cumsum([0, *(len(t) + 1 for t in low)])
        cut_at = np.searchsorted(edge[::2], text)
        h = _xxh64(joined.encode("utf-8", "surrogatepass"), start, size)
        found = [h[x:y] for x, y in zip(cut_at, cut_at[1:])]
        for i in odd:
            found[i] = word_hashes(texts[at + i])
        out += found
    return out


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of places with sizes of about ``most`` in all; a larger one ends a run."""
    first, held = 0, 0
    for i, n in enumerate(sizes, 1):
        held += n
        if held >= most or i == len(sizes):
            yield first, i
            first, held = i, 0


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a text of fewer words is one shingle, an empty one none."""
    k = min(k, len(words))
    if k == 0:
        return words[:0]
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h * _U(0x9E3779B97F4A7C15)) + words[i : n + i]
        h ^= h >> _U(29)
    return mix64(h)


def lean(run: Callable) -> Callable:
    """run, an Arrow function, with what it held given back to the system at its end: workers stay for other tasks, and their memory counts with the executor's."""

    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        _hashes.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not the C library that has it
            pass

    return inner


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name = "_" + name
    return name


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cuts: list[tuple[SparkSession, str]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="glossa-"))
    return "file://" + _own_dir[0]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor. The shuffle files behind it go once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _cuts.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._glossa_cut = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes the table of a cut() that nothing reads any more."""
    path = getattr(df, "_glossa_cut", None)
    if path:
        _delete(df.sparkSession, path)
        _cuts[:] = [x for x in _cuts if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _cuts:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            pass


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    edges (a BIGINT, b BIGINT); nulls and loops count for nothing. Returns (node, root) for
    each node that has an edge, root being the least node of its component. Alternating large-star and
    small-star rounds, each a shuffle of at most as many rows as there are edges; the number of rounds
    is logarithmic in the size of the largest component.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, sign = cut(e), None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, large.u == low.k).select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut(small.unionAll(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_cut(e)
        e = nxt
        if now == sign:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        sign = now
