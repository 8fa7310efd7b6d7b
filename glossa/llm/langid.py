"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in both directions, labels every byte with a language, and
a document's probabilities are the mean over its bytes. Gates are hard sigmoids and candidates hard tangents, so
that a step is a matrix product and a few passes of the processor. It is trained here in numpy by
backpropagation through time, on a bounded sample of labelled rows (``sample_rows``: the rows of least hash) and on
made noise that stands for the label ``und``. Prediction covers every byte of every row: texts are cut
into segments of SEGMENT bytes, which run through the network side by side.

A document is accepted when its likeliest label is a language and the probability of that is at least
``least``.

Edge cases: a null or empty text, and any text when no row has a label to train on, has null lang and prob
and is rejected. Repeated rows are each judged for themselves. Texts of any length are read whole. Equal
probabilities go to the label that comes first in sorted order. Other columns, of whatever name, pass
through ``accept`` untouched. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import fresh, lean

UND = "und"
HIDDEN = 8
SEGMENT = 128
BATCH = 4096
SAMPLE_ROWS = 400
LEAST = 0.3
_PAD = 256


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


class Network:
    """Parameters: for each direction the input table (257, 3H), the recurrent matrix (H, 3H) and a bias of the candidate; the readout."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 1):
        g, h, c = np.random.default_rng(seed), hidden, len(labels)
        self.labels, self.hidden = labels, hidden
        self.p = {f"E{d}": g.normal(0, 0.3, (257, 3 * h)) for d in "fb"} | {f"U{d}": g.normal(0, h**-0.5, (h, 3 * h)) for d in "fb"} | {f"c{d}": np.zeros(h) for d in "fb"} | {"R": g.normal(0, 0.3, (2 * h, c)), "r": np.zeros(c)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the bytes x (steps, batch) with labels y (batch), and its gradients."""
        p, h, (steps, batch) = self.p, self.hidden, x.shape
        states, kept = {}, {}
        for d in "fb":
            s, out, mem = np.zeros((batch, h), np.float32), np.empty((steps, batch, h), np.float32), [None] * steps
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                a, u = p["E" + d][x[t]], s @ p["U" + d]
                v = u[:, 2 * h :] + p["c" + d]
                z, r = _gate(a[:, :h] + u[:, :h]), _gate(a[:, h : 2 * h] + u[:, h : 2 * h])
                n = np.clip(a[:, 2 * h :] + r * v, -1, 1)
                mem[t] = s, z, r, n, v
                out[t] = s = n + z * (s - n)
            states[d], kept[d] = out, mem
        both = np.concatenate([states["f"], states["b"]], 2)
        logit = both @ p["R"] + p["r"]
        e = np.exp(logit - logit.max(2, keepdims=True))
        q = e / e.sum(2, keepdims=True)
        at = np.arange(batch)
        loss = -np.log(q[:, at, y] + 1e-9).mean()
        q[:, at, y] -= 1
        q /= steps * batch
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["R"], grad["r"] = np.tensordot(both, q, ((0, 1), (0, 1))), q.sum((0, 1))
        back = q @ p["R"].T
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            carry, da = np.zeros((batch, h), np.float32), np.empty((steps, batch, 3 * h), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                s, z, r, n, v = kept[d][t]
                g = part[t] + carry
                dn = g * (1 - z) * (np.abs(n) < 1)
                dz = g * (s - n) * 0.25 * ((z > 0) & (z < 1))
                dr = dn * v * 0.25 * ((r > 0) & (r < 1))
                du = np.concatenate([dz, dr, dn * r], 1)
                da[t] = np.concatenate([dz, dr, dn], 1)
                grad["U" + d] += s.T @ du
                grad["c" + d] += du[:, 2 * h :].sum(0)
                carry = g * z + du @ p["U" + d].T
            np.add.at(grad["E" + d], x.ravel(), da.reshape(-1, 3 * h))
        return float(loss), grad

    def label(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For bytes x (steps, batch), _PAD after the end: sums of the probabilities and counts of the likeliest labels, (labels, batch) each."""
        p, h, (steps, batch) = self.p, self.hidden, x.shape
        table, state = {}, {}
        for d in "fb":
            e = p["E" + d].copy()
            e[:, : 2 * h] = e[:, : 2 * h] * 0.25 + 0.5
            e[_PAD] = 0
            e[_PAD, :h] = 1e6  # the update gate stays shut
            u = p["U" + d].copy()
            u[:, : 2 * h] *= 0.25
            table[d], state[d] = np.ascontiguousarray(e.T), np.ascontiguousarray(u.T)
        forward = np.empty((steps, h, batch), np.float32)
        gates, v, a = np.empty((2 * h, batch), np.float32), np.empty((h, batch), np.float32), np.empty((3 * h, batch), np.float32)
        c = {d: p["c" + d][:, None] for d in "fb"}

        def step(d: str, t: int, s: np.ndarray, out: np.ndarray) -> None:
            np.take(table[d], x[t], axis=1, out=a, mode="clip")
            u = state[d] @ s
            np.add(a[: 2 * h], u[: 2 * h], out=gates)
            np.clip(gates, 0, 1, out=gates)
            np.add(u[2 * h :], c[d], out=v)
            np.multiply(v, gates[h:], out=v)
            np.add(v, a[2 * h :], out=v)
            np.clip(v, -1, 1, out=v)
            np.subtract(s, v, out=out)
            np.multiply(out, gates[:h], out=out)
            np.add(out, v, out=out)

        s = np.zeros((h, batch), np.float32)
        for t in range(steps):
            step("f", t, s, forward[t])
            s = forward[t]
        left, right, bias = np.ascontiguousarray(p["R"][:h].T), np.ascontiguousarray(p["R"][h:].T), p["r"][:, None]
        total, count = np.zeros((len(self.labels), batch), np.float32), np.zeros((len(self.labels), batch), np.int32)
        s, other = np.zeros((h, batch), np.float32), np.empty((h, batch), np.float32)
        for t in range(steps - 1, -1, -1):
            step("b", t, s, other)
            s, other = other, s
            logit = left @ forward[t]
            logit += right @ s
            logit += bias
            logit -= logit.max(0)
            there = x[t] != _PAD
            count += (logit == 0) & there
            np.exp(logit, out=logit)
            logit *= there / logit.sum(0)
            total += logit
        return total, count


def _noise(g: np.random.Generator, n: int) -> list[bytes]:
    """Made segments in no language: digits, hexadecimal, base64, printable and arbitrary bytes."""
    kinds = [b"0123456789 .,-+:/\n", b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", bytes(range(33, 65)) + b" ", bytes(range(256))]
    return [bytes(g.choice(np.frombuffer(kinds[i % len(kinds)], np.uint8), SEGMENT)) for i in range(n)]


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, rounds: int = 260, batch: int = 160, steps: int = 48, seed: int = 1) -> Network | None:
    """A network fitted to labelled texts; None if there are none."""
    g = np.random.default_rng(seed)
    by: dict[str, list[bytes]] = {}
    for t, k in zip(texts, langs):
        if t and k and k != UND and len(b := t.encode()) >= 16:
            by.setdefault(k, []).append(b)
    if not by:
        return None
    by[UND] = _noise(g, 200)
    net = Network(sorted(by), hidden, seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for i in range(1, rounds + 1):
        y = g.integers(0, len(net.labels), batch)
        x = np.empty((steps, batch), np.int64)
        for j, k in enumerate(y):
            one = by[net.labels[k]]
            b = np.frombuffer(one[g.integers(len(one))], np.uint8)
            at = g.integers(0, max(1, len(b) - steps + 1))
            x[:, j] = np.resize(b[at : at + steps], steps)
        _, grad = net.loss(x, y)
        norm = np.sqrt(sum(float((q**2).sum()) for q in grad.values()))
        rate = 0.02 * min(1, i / 20) * (1 - 0.9 * i / rounds)
        for k, q in grad.items():
            q *= min(1, 1 / (norm + 1e-9))
            m[k] += 0.1 * (q - m[k])
            v[k] += 0.01 * (q * q - v[k])
            net.p[k] -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    return net


def predict(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the mean probabilities and label counts of its bytes, and its number of bytes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), n)
    flat = np.frombuffer(b"".join(texts) + b"\0" * SEGMENT, np.uint8)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(np.cumsum(size) - size, n) + k * SEGMENT
    left = np.minimum(size[owner] - k * SEGMENT, SEGMENT)
    total, count = np.zeros((len(texts), len(net.labels))), np.zeros((len(texts), len(net.labels)), np.int64)
    place = np.arange(SEGMENT)
    for s in range(0, len(owner), BATCH):
        t = slice(s, s + BATCH)
        x = flat[start[t, None] + place].astype(np.int64)
        x[place >= left[t, None]] = _PAD
        p, c = net.label(np.ascontiguousarray(x.T))
        np.add.at(total, owner[t], p.T)
        np.add.at(count, owner[t], c.T)
    return total / np.maximum(size, 1)[:, None], count, size


def _judge(net: Network | None, texts: list[str | None]) -> dict[str, list]:
    null = [None] * len(texts)
    if net is None:
        return {"lang": null, "prob": null, "n_bytes": [None if t is None else len(t.encode()) for t in texts], "share": null}
    raw = [t.encode() if t else b"" for t in texts]
    mean, count, size = predict(net, raw)
    best = mean.argmax(1)
    some, at = size > 0, np.arange(len(texts))
    pick = lambda x: [y if ok else None for y, ok in zip(x.tolist(), some)]
    return {"lang": [net.labels[b] if ok else None for b, ok in zip(best, some)], "prob": pick(mean[at, best].astype(float)), "n_bytes": [None if t is None else int(n) for t, n in zip(texts, size)], "share": pick(count[at, best] / np.maximum(size, 1))}


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, seed: int = 1) -> Network | None:
    """Trains on the sample_rows labelled rows of least hash of their id (and text); this bounds what the driver holds."""
    d = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"))
    d = d.where("t is not null and l is not null")
    last = d.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]  # first the hashes alone, so that each task sends no more than those
    if last is None:
        return None
    rows = d.where(F.col("h") <= last).orderBy("h", "t", "l").limit(sample_rows).select("t", "l").collect()
    return train([r.t for r in rows], [r.l for r in rows], seed=seed)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, lang, prob, n_bytes, share, accepted) for each row; share is the part of its bytes that are labelled lang."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    names = ["lang", "prob", "n_bytes", "share"]
    types = [pa.string(), pa.float64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                found = _judge(held.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[k], t) for k, t in zip(names, types))], ["doc_id", *names])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(lean(run), "doc_id bigint, lang string, prob double, n_bytes bigint, share double")
    return d.withColumn("accepted", F.coalesce((F.col("lang") != UND) & (F.col("prob") >= least), F.lit(False)))


def accept(docs: DataFrame, net: Network | None, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of docs that are accepted, with all their columns and nothing else."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("boolean")
    def ok(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for s in range(0, len(texts), 1000):
                found = _judge(held.value, texts.iloc[s : s + 1000].tolist())
                out += [k is not None and k != UND and p >= least for k, p in zip(found["lang"], found["prob"])]
            yield pd.Series(out, dtype=bool)

    name = fresh(docs, "_accepted")
    return docs.withColumn(name, ok(F.col(text_col))).where(F.col(name)).drop(name)
