"""Byte-level BPE by merge replay over a corpus, and its inverse.

The texts of a chunk of documents are cut by the tokenizer's pattern; each distinct word is kept once. Then the
merges are replayed in rank order over all distinct words at once: an inverted index leads from a rank to
the positions where a pair that gives it stands, a merge takes effect at all of them, and only the pairs of
touched neighbours are looked up and entered into the index anew. Documents get their ids by looking up
their words. A word's ids depend on nothing but the word, so tasks need not talk to each other: there is no shuffle.

The vocabulary is a file of base64 tokens and ranks; its path is a parameter. It is read on the driver and
broadcast: its size is that of the vocabulary, whatever the data's.

Edge cases: a null text has null ids and null n_tokens, an empty one an empty list and 0. Repeated rows and
ids are encoded each for itself. Long texts are encoded whole. Other columns don't matter. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.llm.common import lean

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_BYTES = 5_000_000
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Tokens by id, and for each pair of ids the id of their merge, which is its rank."""

    def __init__(self, raw: bytes):
        tokens = {}
        for line in raw.splitlines():
            if line.strip():
                token, rank = line.split()
                tokens[base64.b64decode(token)] = int(rank)
        if any(bytes([i]) not in tokens for i in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        self.byte_id = np.array([tokens[bytes([i])] for i in range(256)], np.int32)
        by_id = [b""] * (max(tokens.values()) + 1)
        keys, ids = [], []
        for token, i in tokens.items():
            by_id[i] = token
            for c in range(1, len(token)):
                a, b = tokens.get(token[:c]), tokens.get(token[c:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ids = np.array(keys, np.int64)[order], np.array(ids, np.int32)[order]
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.ends = np.cumsum([len(x) for x in by_id])
        self.sizes = np.array([len(x) for x in by_id], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it has no merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], _NONE)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, joined."""
        return _gather(self.flat, self.ends[ids] - self.sizes[ids], self.sizes[ids])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size], joined."""
    if not len(size):
        return flat[:0]
    end = np.cumsum(size)
    return flat[np.repeat(start - (end - size), size) + np.arange(end[-1])]


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All merges over all words; the ids of all words, joined, and the number of ids of each. No word is empty."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    n = int(end[-1]) if len(words) else 0
    if not n:
        return np.zeros(0, np.int32), size
    sym = np.r_[vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1)]
    nxt, prv = np.arange(1, n + 2), np.arange(-1, n)  # n is the place beyond either end of a word
    nxt[end - 1] = n
    prv[end - size] = n
    rank = np.r_[vocab.ranks(sym[:n], sym[nxt[:n]]), _NONE]
    gone = np.zeros(n + 1, bool)
    index: dict[int, list[np.ndarray]] = {}

    def enter(at: np.ndarray) -> None:
        r = rank[at]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]).tolist()
        for x, y in zip(first, [*first[1:], len(r)]):
            if (q := int(r[x])) in index:
                index[q].append(at[x:y])
            else:
                index[q] = [at[x:y]]
                heapq.heappush(heap, q)

    heap: list[int] = []
    if len(some := np.flatnonzero(rank != _NONE)):
        enter(some)
    while heap:
        r = heapq.heappop(heap)
        at = index.pop(r)
        at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
        at = at[rank[at] == r]
        if len(at) > 1:  # of overlapping places, every second one counted from the left
            joined = np.r_[False, at[1:] == nxt[at[:-1]]]
            if joined.any():
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(joined, 0, k))) % 2 == 0]
        if not len(at):
            continue
        second = nxt[at]
        after = nxt[second]
        sym[at], nxt[at] = r, after
        prv[after] = at
        gone[second] = True
        rank[second] = _NONE
        before = prv[at]
        touched = np.r_[before[before != n], at]
        right = nxt[touched]
        new = np.where(right == n, _NONE, vocab.ranks(sym[touched], sym[right]))
        rank[touched] = new
        touched = touched[new != _NONE]
        if len(touched):
            enter(touched)
        rank[n], sym[n], gone[n] = _NONE, -1, False
    left = ~gone[:n]
    return sym[:n][left], np.add.reduceat(left, end - size, dtype=np.int64)


class _Index(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_split = regex.compile(PATTERN)
# Over Latin letters, ASCII digits and common marks the pattern is the same with these ranges, which the standard library takes faster.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_latin = re.compile("[\t\n\r -~\xa0-±´-¸º»¿-ɏ‐-‧€]*")
_split_latin = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


def split(text: str) -> list[str]:
    """The words of a text, as PATTERN cuts it."""
    return (_split_latin if _latin.fullmatch(text) else _split).findall(text)


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, joined, and the number of ids of each."""
    index = _Index()
    found = []
    for t in texts:
        words = split(t)
        found.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    ids, size = replay([w.encode() for w in index], vocab)
    word = np.concatenate(found) if found else np.zeros(0, np.int32)
    start = np.cumsum(size) - size
    per_word = size[word]
    total = np.r_[0, np.cumsum(per_word)][np.cumsum([0, *map(len, found)])]
    return _gather(ids, start[word], per_word), np.diff(total)


def decode(ids: list[int] | np.ndarray, vocab: Vocabulary) -> str:
    """The text of a list of ids; bytes that are not UTF-8 become U+FFFD."""
    return vocab.bytes_of(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


def _encode(raw, check: bool):
    def chunk(ids: list, texts: list, vocab: Vocabulary) -> pa.RecordBatch:
        known = [t for t in texts if t is not None]
        flat, n = encode_texts(known, vocab)
        null = np.array([t is None for t in texts], bool)
        size = np.zeros(len(texts), np.int64)
        size[~null] = n
        offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32), mask=np.r_[null, False])
        out = [pa.array(ids, pa.int64()), pa.array(size, mask=null), pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))]
        if check:
            back = vocab.bytes_of(flat)
            wide = np.r_[0, np.cumsum(vocab.sizes[flat])]
            edge = wide[np.r_[0, np.cumsum(n)]]
            same = [back[x:y].tobytes() == t.encode() for t, x, y in zip(known, edge, edge[1:])]
            ok = np.zeros(len(texts), bool)
            ok[~null] = same
            out.append(pa.array(ok, mask=null))
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids", "round_trip"][: len(out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(raw.value)
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                held += len(t or "")
                if held >= CHUNK_BYTES:
                    yield chunk(ids, texts, vocab)
                    ids, texts, held = [], [], 0
        if ids:
            yield chunk(ids, texts, vocab)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, check: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids) and, with check, round_trip: whether decoding the ids gives back the text's bytes."""
    with open(vocabulary, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id bigint, n_tokens bigint, ids array<int>" + ", round_trip boolean" * check
    return docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).mapInArrow(lean(_encode(raw, check)), schema)


def decode_column(ids: str, spark, vocabulary: str = VOCABULARY):
    """A column with the texts of a column of id lists; null stays null."""
    import pandas as pd

    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.StringType())
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = Vocabulary(raw.value)
        for s in batches:
            yield s.map(lambda x: None if x is None else decode(x, vocab)).astype(object)

    return back(F.col(ids))
