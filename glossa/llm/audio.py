"""Chroma fingerprints of a media column, and the alignment of recordings by them.

A recording (WAV, 16-bit PCM; channels are averaged) is cut into frames; each frame's spectrum gives the energy of 12 pitch classes, scaled to
norm 1. Over the frames a table of sums (integral image) is made, so that any rectangle's energy is four look-ups; each of 16 filters
compares the parts of a window of frames and pitch classes, and its value is cut at three thresholds into a 2-bit Gray code. 16 codes pack into one
32-bit integer for each window.

A place's keys are two of the four bytes of its integer and the same two of the integer LATER windows on, in six choices. Where two recordings agree in a
key, the integers at CONTEXT beside it are compared, and if at most SLACK * ``errors`` of their bits differ, the place enters the pair's histogram of offsets. At each offset
of the histogram the bits that differ are counted over the whole overlap; the offset with the least share is taken (then that with most places, then the least). A pair
is a match with at most ``errors`` of the bits wrong over at least ``overlap`` windows. Recordings with equal fingerprints are folded first, and only the least id of
them is matched with others. Keys are counted in BINS bins before the join; those of a bin of more than HOT places are spread over cells of pairs of salts, so
that every pair still meets, in one cell, and no cell holds many more than twice HOT places.

Edge cases: null, empty or undecodable bytes, and recordings shorter than one window, have a null fingerprint and no
match, but a row of their own. Rows without an id are left out. Rows that repeat an id are one recording: that with the least bytes of fingerprint. Silence has a fingerprint
of its own kind and matches silence. Long recordings are read whole, a run of frames at a time. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import components, cut, lean, mix64

RATE, FRAME, HOP, SPAN, LATER = 4000, 512, 128, 16, 16
ERRORS, OVERLAP = 0.2, 32
CONTEXT = np.array([4, 8, 12, 20, 24, 28])
BINS, HOT = 1 << 20, 8192
SLACK = 1.25
_RUN, _SLICE, _AT_ONCE = 2048, 256, 400_000
_NOTE = 256
_EPS = 0.05
_PLACE = np.dtype([("id", "<i8"), ("at", "<i4"), ("side", "<i4"), ("context", "<u4", (len(CONTEXT),))])
#: kind, lowest pitch class, pitch classes, frames: kinds compare 0 halves by pitch, 1 halves by time, 2 quarters crosswise, 3 the middle third by pitch, 4 the middle third by time.
_FILTERS = [(0, 0, 12, 16), (0, 0, 6, 16), (0, 6, 6, 16), (0, 3, 6, 12), (1, 0, 4, 16), (1, 4, 4, 16), (1, 8, 4, 16), (1, 0, 12, 8), (2, 0, 6, 16), (2, 6, 6, 16), (2, 3, 6, 12), (3, 0, 6, 16), (3, 6, 6, 16), (3, 3, 9, 16), (4, 0, 6, 15), (4, 6, 6, 15)]
_CUTS = np.array([-0.35, 0.0, 0.35])
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def decode(data: bytes | None) -> tuple[np.ndarray, int] | None:
    """Samples in [-1, 1] and their rate; None for what isn't 16-bit PCM WAV."""
    if not data:
        return None
    try:
        with wave.open(io.BytesIO(data)) as w:
            if w.getsampwidth() != 2:
                return None
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(1) / 32768
            return (x, w.getframerate()) if w.getframerate() > 0 else None
    except (wave.Error, EOFError, ValueError, struct.error):
        return None


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12) energies of pitch classes, each frame of norm 1 or 0; frames last FRAME / RATE seconds."""
    frame, hop = round(FRAME * rate / RATE), max(1, round(HOP * rate / RATE))
    if len(x) < frame:
        return np.zeros((0, 12))
    windows = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    f = np.arange(frame // 2 + 1) * rate / frame
    use = (f > 100) & (f < 1800)
    pitch = 12 * np.log2(np.maximum(f[use], 1) / 440) + 69
    low = np.floor(pitch)
    share = np.zeros((use.sum(), 12))
    np.add.at(share, (np.arange(use.sum()), low.astype(int) % 12), 1 - (pitch - low))
    np.add.at(share, (np.arange(use.sum()), (low.astype(int) + 1) % 12), pitch - low)
    taper = np.hanning(frame)
    c = np.concatenate([np.sqrt(np.abs(np.fft.rfft(windows[i : i + _RUN] * taper, axis=1)[:, use]) ** 2 @ share) for i in range(0, len(windows), _RUN)])
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return np.where(norm > 1e-3, c / np.maximum(norm, 1e-9), 0)


def fingerprint(c: np.ndarray) -> np.ndarray:
    """One packed integer for each window of SPAN frames."""
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = np.cumsum(np.cumsum(c, 0), 1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in _FILTERS:
        whole = area(0, w, y, y + h)
        if kind == 0:
            a = area(0, w, y, y + h // 2)
        elif kind == 1:
            a = area(0, w // 2, y, y + h)
        elif kind == 2:
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 3:
            a = area(0, w, y + h // 3, y + 2 * h // 3)
        else:
            a = area(w // 3, 2 * w // 3, y, y + h)
        b = whole - a
        if kind in (3, 4):
            b = b / 2
        value = np.log((a + _EPS * w) / (b + _EPS * w))
        out = out << np.uint32(2) | _GRAY[np.searchsorted(_CUTS, value, "right")]
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for m in b.column(1):
            x = decode(m.as_py())
            p = fingerprint(chroma(*x)) if x is not None else ()
            out.append(np.asarray(p, "<u4").tobytes() if len(p) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "print"])


def fingerprints(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, print): four bytes for each window, the least first; null where there is none."""
    d = media.select(F.col(id_col).cast("bigint").alias("id"), F.col(media_col).cast("binary").alias("m")).where("id is not null")
    return d.mapInArrow(lean(_prints), "id bigint, print binary").groupBy("id").agg(F.min("print").alias("print"))


_TWO = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def keys(f: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each choice of bytes the keys of the places that have their whole context, and these places; of equal neighbours the first."""
    n = len(f) - int(CONTEXT[-1])
    f = f.astype(np.int64)
    if n > 0:
        for j, (a, b) in enumerate(_TWO):
            half = (f >> 8 * a & 0xFF) << 8 | f >> 8 * b & 0xFF
            k = j << 32 | half[:n] << 16 | half[LATER : LATER + n]
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            yield k[at], at


def _places(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, id, place, context) of a few recordings at a time."""
    for s in range(0, b.num_rows, _SLICE):
        part = b.slice(s, _SLICE)
        found: list[tuple] = []
        for i, p in zip(part.column(0).to_pylist(), part.column(1)):
            f = np.frombuffer(p.as_py(), "<u4")
            for k, at in keys(f):
                found.append((k, np.full(len(at), i), at.astype(np.int32), f[at[:, None] + CONTEXT]))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))


def _bin(key: np.ndarray) -> np.ndarray:
    return (mix64(key.view(np.uint64)) % np.uint64(BINS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(BINS, np.int64)
    for b in batches:
        for k, *_ in _places(b):
            np.add.at(n, _bin(k), 1)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bin", "n"])


def _cells(given):
    """Rows (cell, place). A key of a bin with one salt is one cell, of side 2; else a place with salt r goes to the cells (r, c) of all salts c,
    and a cell of two salts joins places of different sides only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = np.ones(BINS, np.int64)
        for k, n in given.value:
            salts[k] = n
        for b in batches:
            for k, i, at, context in _places(b):
                n = salts[_bin(k)]
                row = np.repeat(np.arange(len(k)), n)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                own = (mix64(i.view(np.uint64)).astype(np.uint64) % n.astype(np.uint64)).astype(np.int64)[row]
                pair = mix64((np.minimum(own, other) << 32 | np.maximum(own, other)).view(np.uint64)).view(np.int64)
                cell = k[row] ^ np.where(n[row] > 1, pair << 36, 0)
                data = np.empty(len(row), _PLACE)
                data["id"], data["at"], data["side"], data["context"] = i[row], at[row], np.where(own == other, 2, own > other), context[row]
                ends = pa.py_buffer((np.arange(len(row) + 1) * _PLACE.itemsize).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(data)])], ["cell", "place"])

    return run


def _pairs(errors: float):
    """Of rows sorted by cell: (a, b, entry), entry being offset * 2**32 + hits, of the pairs of one cell whose contexts agree. Cells go on over batches."""

    def joined(cell: np.ndarray, side: np.ndarray, i: np.ndarray, t: np.ndarray, context: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        n = np.searchsorted(cell, cell, "right") - np.arange(len(cell)) - 1
        edge = np.cumsum(n)
        row = 0
        while row < len(cell):
            upto = max(row + 1, int(np.searchsorted(edge, (edge[row - 1] if row else 0) + _AT_ONCE, "right")))
            m = n[row:upto]
            a = np.repeat(np.arange(row, upto), m)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
            ok = (i[a] != i[b]) & ((side[a] != side[b]) | (side[a] == 2))
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(context[a] ^ context[b]).sum(1, dtype=np.int64) <= SLACK * errors * 64 * context.shape[1]
            a, b = a[ok], b[ok]
            if len(a):
                turn = i[a] > i[b]
                a, b = np.where(turn, b, a), np.where(turn, a, b)
                yield i[a], i[b], t[a] - t[b]
            row = upto

    def counted(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b, o = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((o, b, a))
        a, b, o = a[order], b[order], o[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (o[1:] != o[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array((o[first].astype(np.int64) << 32) + np.diff(np.r_[first, len(a)]))], ["a", "b", "entry"])

    def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held = None
        for batch in batches:
            for s in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(s, _AT_ONCE)
                places = np.frombuffer(b"".join(part.column(1).to_pylist()), _PLACE)
                cols = [part.column(0).to_numpy(), *(np.ascontiguousarray(places[x]) for x in ("side", "id", "at")), np.ascontiguousarray(places["context"]).view("<u8")]
                if held is not None:
                    cols = [np.concatenate(x) for x in zip(held, cols)]
                upto = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
                yield tuple(c[:upto] for c in cols)
                held = [c[upto:] for c in cols]
        if held is not None:
            yield tuple(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for cols in whole_cells(batches):
            for x in joined(*cols):
                held.append(x)
                n += len(x[0])
                if n >= _AT_ONCE:
                    yield counted(held)
                    held, n = [], 0
        if held:
            yield counted(held)

    return run


def _verify(least: int):
    """Of (a, b, places, p, q) the best offset with an overlap of ``least`` windows: by share of differing bits, then by places, then by distance."""

    def best(places: list[int], p: np.ndarray, q: np.ndarray) -> tuple:
        hits: dict[int, int] = {}
        for x in places:
            hits[x >> 32] = hits.get(x >> 32, 0) + (x & 0xFFFFFFFF)
        tried = []
        for o, h in hits.items():
            lo, hi = max(0, o), min(len(p), len(q) + o)
            if hi - lo >= least:
                tried.append((int(np.bitwise_count(p[lo:hi] ^ q[lo - o : hi - o]).sum()) / (32 * (hi - lo)), -h, abs(o), o, hi - lo))
        return min(tried, default=(None, 0, 0, 0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [best(places, np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")) for places, p, q in zip(*(b.column(c).to_pylist() for c in ("places", "p", "q")))]
            e, h, _, o, n = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(o, pa.int32()), pa.array([-x for x in h], pa.int64()), pa.array(n, pa.int64()), pa.array(e, pa.float64())], ["id", "other_id", "offset", "hits", "overlap", "errors"])

    return run


def _candidates(prints: DataFrame, errors: float) -> DataFrame:
    """(a, b, places): the histogram of each pair, an entry being offset * 2**32 + hits."""
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bins = prints.mapInArrow(lean(_count), "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    given = spark.sparkContext.broadcast([(r.bin, -(-r.n // HOT)) for r in bins.collect()])  # BINS rows at most
    cells = prints.mapInArrow(lean(_cells(given)), "cell bigint, place binary").repartition(parts, "cell").sortWithinPartitions("cell")
    return cut(cells.mapInArrow(lean(_pairs(errors)), "a bigint, b bigint, entry bigint").groupBy("a", "b").agg(F.collect_list("entry").alias("places")))


def pairs(heads: DataFrame, errors: float = ERRORS, overlap: int = OVERLAP) -> DataFrame:
    """(id, other_id, offset, hits, overlap, errors), id < other_id, of heads (id, print) with distinct ids and prints: window t of id sounds like window t - offset of other_id.

    hits: places in the histogram at this offset. errors: the share of differing bits.
    """
    prints = heads.select("id", "print")
    found = _candidates(prints, errors)
    sides = found.join(prints.select(F.col("id").alias("a"), F.col("print").alias("p")), "a").join(prints.select(F.col("id").alias("b"), F.col("print").alias("q")), "b")
    near = sides.select("a", "b", "places", "p", "q").mapInArrow(lean(_verify(overlap)), "id bigint, other_id bigint, offset int, hits bigint, overlap bigint, errors double")
    return near.where(F.col("errors") <= errors)


def align(media: DataFrame, id_col: str, media_col: str, errors: float = ERRORS, overlap: int = OVERLAP) -> DataFrame:
    """One row for each id: (id, group_id, copies, links, nearest_id, offset, overlap, errors).

    group_id: the least id of the recordings that matches and copies lead to. copies: other recordings with an equal fingerprint. links: other fingerprints that
    match. nearest_id: of the match with the least errors (then the least id) the least id, with its offset, overlap and errors; null without one.
    """
    prints = cut(fingerprints(media, id_col, media_col))
    heads = cut(prints.where("print is not null").groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    near = cut(pairs(heads, errors, overlap))
    member = prints.join(heads.select("print", F.col("id").alias("head"), "n"), "print", "left").select("id", F.coalesce("head", "id").alias("head"), (F.coalesce("n", F.lit(1)) - 1).alias("copies"))
    cols = ["offset", "overlap", "errors"]
    both = near.select("id", "other_id", *cols).unionAll(near.select("other_id", "id", -F.col("offset"), "overlap", "errors"))
    best = both.groupBy("id").agg(F.count("*").alias("links"), F.min(F.struct("errors", "other_id", "offset", "overlap")).alias("b"))
    groups = components(near.select(F.col("id").alias("a"), F.col("other_id").alias("b")))
    of_head = best.join(groups, best.id == groups.node).select(F.col("id").alias("head"), "root", "links", F.col("b.other_id").alias("nearest_id"), *(F.col(f"b.{c}").alias(c) for c in cols))
    out = member.join(of_head, "head", "left")
    return out.select("id", F.coalesce("root", "head").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "nearest_id", *cols)


def render(values: np.ndarray) -> bytes:
    """A recording in which each value is a note, its pitch within an octave following the value in units of the vector's deviation; WAV bytes."""
    v = np.asarray(values, float)
    v = np.where(np.isfinite(v), v, 0)
    spread = v.std() or 1.0
    midi = 66 + 6 * np.clip(v / spread / 2.5, -1, 1)
    f = np.repeat(440 * 2 ** ((midi - 69) / 12), _NOTE)
    phase = 2 * np.pi * np.cumsum(f) / RATE
    x = 0.6 * np.sin(phase) + 0.2 * np.sin(2 * phase)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 256):
            part = b.slice(s, 256)
            media = [render(np.asarray(v.as_py(), float)) if v.is_valid and len(v) else None for v in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["id", "media"])


def media_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, media): each vector as a recording."""
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).mapInArrow(lean(_render), "id bigint, media binary")
