"""Language-model scores: causal self-attention over subword ids, trained in numpy.

1. Every text is encoded (glossa.llm.bpe); the ids are written to the shared folder, two bytes each.
2. All ids of the corpus are counted and ranked by count; ranks from SYMBOLS on share one input symbol. The ranking is cut into CLASSES classes of about the
   same mass, and p(id | context) = p(class | context) * p(id | class, context), both read out of the network; ids of a class from rank OUT on are one outcome,
   shared out by the counts plus one.
3. Training: the corpus, each distinct (id, text) once, is dealt by hash to shards of about SHARD_IDS ids. A shard is one stream of texts cut into windows of
   2 * STRIDE inputs, in which an id sees what stands before it in its text; so each id is a target once a round. In each of ROUNDS rounds every shard trains
   a copy of the network (Adam, backpropagation), and the copies are averaged, weighted by their windows, by a shuffle of parameter blocks. The driver gets
   one network. Neither shards nor their order depend on files or tasks.
4. Scoring: windows of 2 * STRIDE inputs begin every STRIDE ids, and score their last STRIDE ids; so each id is scored once and
   sees STRIDE to 2 * STRIDE - 1 ids before it, or all if there are fewer. Windows of many texts are run as one batch with a mask.

The network has one head: input vectors, query, key and value matrices, a bias for each distance, and a readout of the attended value
plus the input vector. The readout starts as the counts of the corpus.

Edge cases: a null text has null n_tokens, nll and bits; an empty one has n_tokens 0, nll 0 and null bits. Repeated rows and ids are scored
each for itself, and weigh in the counts as often as they come. Texts of any length are scored whole. Rows without an id are scored too. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import bpe
from glossa.llm.common import cut, lean

SYMBOLS, OUT, CLASSES, WIDTH, STRIDE, ROUNDS = 4096, 4096, 64, 16, 16, 1
SHARD_IDS = 1 << 21
_BATCH, _RATE, _PARAM_BLOCKS, _SCORED = 128, 0.015, 16, 8192
_TEXT_BYTES, _ID_BYTES = 12_000_000, 1_000_000
_BLOCK = 32  # outcomes of small classes in one product
_RUN = 512  # rows in one product: narrow products of up to about a million multiplications run without packing their operands
_NO = np.float32(-1e9)
_SAFE, _LEAST = 40.0, 1e-20  # logits up to here, and sums of exponentials from here to 1 / _LEAST, need no shift before the exponential


class Ranking:
    """By corpus counts: the symbol, class and outcome of each id, and log p(id | outcome). Classes and outcomes are runs of ranks; edge[c] is the first outcome of class c."""

    def __init__(self, counts: np.ndarray, symbols: int = SYMBOLS, classes: int = CLASSES, out: int = OUT):
        mass = counts + 1.0
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.symbols = symbols
        self.symbol = np.minimum(rank, symbols - 1).astype(np.int32)
        share = (np.cumsum(mass[order]) - mass[order] / 2) / mass.sum()
        by_rank = np.unique(np.minimum((share * classes).astype(np.int64), classes - 1), return_inverse=True)[1]
        self.cls = by_rank[rank].astype(np.int32)
        self.classes = int(by_rank[-1]) + 1
        tail = by_rank[min(out, len(counts) - 1)]
        outcome = np.where(np.arange(len(counts)) < out, np.arange(len(counts)), out + by_rank - tail)
        self.outcome = outcome[rank].astype(np.int32)
        own = np.bincount(self.outcome, mass)
        self.edge = np.r_[outcome[np.searchsorted(by_rank, np.arange(self.classes))], len(own)]
        self.of = np.repeat(np.arange(self.classes), np.diff(self.edge)).astype(np.int32)
        self.given = (np.log(mass) - np.log(own[self.outcome])).astype(np.float32)
        within = np.bincount(self.cls, mass)
        self.prior = np.log(within / mass.sum()).astype(np.float32)
        self.share = np.log(own / within[self.of]).astype(np.float32)


def _offsets(stride: int) -> np.ndarray:
    """Distance from query to key for each, negative for later keys."""
    return (np.arange(stride, 2 * stride)[:, None] - np.arange(2 * stride)[None]).astype(np.int64)


def _exp(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """exp(z) in place, up to a factor for each row; own has a logit of each row, which so keeps its sum above zero."""
    if z.size and (z.max() > _SAFE or own.min() < -_SAFE):
        z -= z.max(-1, keepdims=True)
    return np.exp(z, out=z)


def _total(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[-1], z.dtype)


def _rows(x: np.ndarray, m: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """x @ m, _RUN rows of x at a time."""
    n = len(x) - len(x) % _RUN
    if not n:
        return np.matmul(x, m, out=out)
    m = np.ascontiguousarray(m)
    if out is None:
        out = np.empty((len(x), m.shape[1]), np.result_type(x, m))
    np.matmul(x[:n].reshape(-1, _RUN, x.shape[1]), m, out=out[:n].reshape(-1, _RUN, m.shape[1]))
    if n < len(x):
        np.matmul(x[n:], m, out=out[n:])
    return out


def _across(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """x.T @ z, summed over _RUN rows of both at a time."""
    n = len(x) - len(x) % _RUN
    if not n:
        return x.T @ z
    out = np.matmul(x[:n].reshape(-1, _RUN, x.shape[1]).transpose(0, 2, 1), z[:n].reshape(-1, _RUN, z.shape[1])).sum(0)
    if n < len(x):
        out += x[n:].T @ z[n:]
    return out


def _weights(x: np.ndarray, m: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """exp(x @ m + mask) up to a factor for each row, and its sums."""
    for shift in (False, True):
        z = _rows(x, m)
        if mask is not None:
            z += mask
        if shift:
            z -= z.max(-1, keepdims=True)
        t = _total(np.exp(z, out=z))
        if not t.size or (t.min() > _LEAST and t.max() < 1 / _LEAST):
            break
    return z, t


def _logits(x: np.ndarray, m: np.ndarray, size: int, runs: list[tuple[slice, slice, slice, np.ndarray | None]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The logits of rows x within their classes, as by_class lays them out; m has the outcomes' vectors. And views of them, a matrix for each block."""
    flat, out = np.empty(size, x.dtype), []
    for r, u, b, mask in runs:
        out.append(_rows(x[r], m[u].T, flat[b].reshape(r.stop - r.start, -1)))
        if mask is not None:
            out[-1] += mask
    return flat, out


def _and_one(x: np.ndarray) -> np.ndarray:
    """x with a last column of ones, by which a product also adds a bias or sums up."""
    out = np.ones((*x.shape[:-1], x.shape[-1] + 1), x.dtype)
    out[..., :-1] = x
    return out


def _blocks(edge: np.ndarray, most: int) -> list[tuple[int, int, slice, np.ndarray | None]]:
    """Runs of classes that share a product of matrices: adjacent ones of up to ``most`` outcomes in all, and larger ones alone; no class of one outcome is alone.

    Each is its classes from and to, their outcomes, and for several what is added to a row's logits for each class, so that the row has outcomes of its own class only.
    """
    out, first, n = [], 0, len(edge) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(edge, edge[first] + most, "right")) - 1)
        u = slice(int(edge[first]), int(edge[last]))
        if last == first + 1:
            mask = None
        else:
            of = np.repeat(np.arange(last - first), np.diff(edge[first : last + 1]))
            mask = np.where(of == np.arange(last - first)[:, None], np.float32(0), _NO)
        if u.stop - u.start > last - first:
            out.append((first, last, u, mask))
        first = last
    return out


class Network:
    """Symbols: 0 .. symbols - 1, then the beginning of a text, then padding."""

    def __init__(self, rank: Ranking, width: int = WIDTH, stride: int = STRIDE, seed: int = 1, block: int = _BLOCK):
        g = np.random.default_rng(seed)
        self.begin, self.pad, self.width, self.stride = rank.symbols, rank.symbols + 1, width, stride
        self.edge, self.of, self.blocks = rank.edge, rank.of, _blocks(rank.edge, block)
        self.within = np.zeros(len(rank.of), np.int64)  # of each outcome, its place in its block
        self.wide = np.zeros(rank.classes, np.int64)  # of each class, the outcomes of its block, 0 if it has none
        for first, last, u, _ in self.blocks:
            self.within[u] = np.arange(u.stop - u.start)
            self.wide[first:last] = u.stop - u.start
        p = {"E": g.normal(0, 0.3, (rank.symbols + 2, width)), **{k: g.normal(0, width**-0.5, (width, width)) for k in "QKVO"}, "D": np.zeros(2 * stride), "W": g.normal(0, 0.05, (width, rank.classes)), "b": rank.prior, "U": g.normal(0, 0.05, (len(rank.of), width)), "c": rank.share}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def take(self, vector: np.ndarray) -> np.ndarray:
        """Takes the parameters from a vector; returns the copy of it that they are views of."""
        own, at = vector.astype(np.float32), 0
        for k, v in self.p.items():
            self.p[k] = own[at : at + v.size].reshape(v.shape)
            at += v.size
        return own

    def copy(self) -> Network:
        out = Network.__new__(Network)
        out.__dict__ = self.__dict__ | {"p": {k: v.copy() for k, v in self.p.items()}}
        return out

    def by_class(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, list[tuple[slice, slice, slice, np.ndarray | None]]]:
        """An order of the outcomes y by class, and in that order their classes. The logits within the classes lie behind one another, row by row: which rows have any, where those have their own outcome, and the number of logits; for each
        block that has rows these, its outcomes, its logits and what is added to them."""
        cls = self.of[y]
        order = np.argsort(cls.astype(np.uint8 if len(self.edge) <= 257 else np.uint16), kind="stable")
        cls = cls[order]
        end, at = np.r_[0, np.cumsum(np.bincount(cls, minlength=len(self.edge) - 1))].tolist(), np.r_[0, np.cumsum(self.wide[cls])]
        runs = []
        for x, z, u, mask in self.blocks:
            if end[x] < end[z]:
                r = slice(end[x], end[z])
                runs.append((r, u, slice(int(at[end[x]]), int(at[end[z]])), None if mask is None else mask.take(cls[r] - x, 0)))
        some = np.flatnonzero(self.wide[cls])
        return order, cls, some, at[some] + self.within[y[order[some]]], int(at[-1]), runs

    @np.errstate(over="ignore")
    def loss(self, s: np.ndarray, y: np.ndarray, text: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the outcomes y (batch, inputs), -1 where there is none, after the symbols s of the same text (number) up to there, and gradients."""
        p, (n, w), d, scale = self.p, s.shape, self.width, np.float32(self.width**-0.5)
        flat = s.ravel()
        x = _and_one(p["E"]).take(flat, 0)
        qkv = np.zeros((d + 1, 3 * d + 1), x.dtype)
        np.concatenate([p["Q"] * scale, p["K"], p["V"]], 1, out=qkv[:-1, :-1])
        qkv[-1, -1] = 1  # the last column of v, and of o below, is one
        q, k, v = np.split(_rows(x, qkv).reshape(n, w, -1), (d, 2 * d), 2)
        dist = np.arange(w)[:, None] - np.arange(w)[None]
        a = q @ k.transpose(0, 2, 1)
        a += np.where(dist < 0, _NO, p["D"][np.maximum(dist, 0)])
        several = np.flatnonzero((text != text[:, :1]).any(1))
        a[several] = np.where(text[several, :, None] != text[several, None, :], _NO, a[several])
        a = _exp(a, a.diagonal(0, 1, 2))  # weights times their sum, which the last column of the product is
        c = (a @ v).reshape(n * w, -1)
        total = c[:, -1:]
        c = c[:, :-1] / total
        o = _rows(c, np.concatenate([p["O"], np.zeros((d, 1), x.dtype)], 1))
        o += x
        there = np.flatnonzero(y.ravel() >= 0)
        order, cls, some, at, size, runs = self.by_class(y.ravel()[there])
        there = there[order]
        oo, m = o.take(there, 0), max(1, len(there))
        odds, own = np.ones((2, len(there)), o.dtype), np.zeros((len(self.of), d + 1), o.dtype)
        z, t = _weights(oo, np.concatenate([p["W"], p["b"][None]]))
        place = np.arange(len(there)) * z.shape[1] + cls
        mine = z.take(place)
        odds[0] = mine / t
        z.reshape(-1)[place] = mine - t
        t = 1 / t[:, None]
        gw = _across(oo * t, z)
        do = _rows(z, p["W"].T)
        do *= t
        uc = np.concatenate([p["U"], p["c"][:, None]], 1)
        one, t = np.ones(int(self.wide.max()), o.dtype), np.ones(len(there), o.dtype)
        for shift in (False, True):
            flat_z, blocks = _logits(oo, uc, size, runs)
            if shift:
                for z in blocks:
                    z -= z.max(-1, keepdims=True)
            np.exp(flat_z, out=flat_z)
            for (r, _, _, _), z in zip(runs, blocks):
                np.matmul(z, one[: z.shape[1]], out=t[r])
            if not t.size or (t.min() > _LEAST and t.max() < 1 / _LEAST):
                break
        mine = flat_z.take(at)
        odds[1, some] = mine / t[some]
        flat_z[at] = mine - t[some]
        t = 1 / t[:, None]
        ot, inner = oo * t, np.zeros_like(do)
        for (r, u, _, _), z in zip(runs, blocks):
            own[u] = _rows(z.T, ot[r])
            np.matmul(z, p["U"][u], out=inner[r])
        inner *= t
        do += inner
        do *= np.float32(1 / m)
        loss = -np.log(odds + 1e-12).sum()
        back = np.full(n * w, len(there))
        back[there] = np.arange(len(there))
        whole = np.concatenate([do, np.zeros((1, d), x.dtype)]).take(back, 0)
        gw *= np.float32(1 / m)
        own *= np.float32(1 / m)
        g = {"W": gw[:-1], "b": gw[-1], "U": own[:, :-1], "c": own[:, -1], "O": _across(c, whole)}
        ds = np.empty((n * w, d + 1), x.dtype)
        np.divide(_rows(whole, p["O"].T), total, out=ds[:, :-1])
        np.negative(np.einsum("ij,ij->i", ds[:, :-1], c), out=ds[:, -1])
        ds = ds.reshape(n, w, -1)
        da = ds @ v.transpose(0, 2, 1)
        da *= a
        g["D"] = np.bincount(np.maximum(dist, 0).ravel(), np.where(dist < 0, 0, da.sum(0)).ravel(), len(p["D"]))
        dx = np.empty((n, w, 3 * d), x.dtype)
        np.matmul(da, k, out=dx[:, :, :d])
        np.matmul(da.transpose(0, 2, 1), q, out=dx[:, :, d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), ds[:, :, :-1], out=dx[:, :, 2 * d :])
        dx = dx.reshape(n * w, -1)
        g["Q"], g["K"], g["V"] = np.split(_across(x[:, :-1], dx), 3, 1)
        g["Q"] *= scale
        dx = _rows(dx, qkv[:-1, :-1].T)
        dx += whole
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        symbol = flat[order]
        first = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        g["E"] = np.zeros_like(p["E"])
        g["E"][symbol[first]] = np.add.reduceat(dx.take(order, 0), first)
        return float(loss) / m, g

    def train(self, s: np.ndarray, y: np.ndarray, text: np.ndarray, rate: float = _RATE, seed: int = 1) -> None:
        """One pass of Adam over the windows, in an order drawn by seed."""
        own = self.take(self.vector())
        m, v = np.zeros_like(own), np.zeros_like(own)
        order = np.random.default_rng(seed).permutation(len(s))
        steps = -(-len(s) // _BATCH)
        for i in range(steps):
            t = order[i * _BATCH : (i + 1) * _BATCH]
            _, grad = self.loss(s[t].astype(np.int32), y[t].astype(np.int32), text[t])
            g = np.concatenate([grad[k].ravel() for k in self.p], dtype=np.float32)
            r, one, two = rate * (1 - 0.9 * i / steps), 0.1 / (1 - 0.9 ** (i + 1)), (0.01 / (1 - 0.99 ** (i + 1))) ** 0.5
            m *= np.float32(0.9)  # m and v without the factors 0.1 and 0.01
            m += g
            g *= g
            v *= np.float32(0.99)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-8 / two)
            np.divide(m, g, out=g)
            g *= np.float32(r * one / two)
            own -= g

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What scoring looks up by symbol: the query, and the key and the value joined. The product of query and key is less by -_NO for a pad; the last column of values is one."""
        p = self.p
        key = np.c_[p["E"] @ p["K"], np.zeros(len(p["E"]), np.float32)]
        key[self.pad, -1] = _NO
        return _and_one(p["E"] @ p["Q"] * np.float32(self.width**-0.5)), np.concatenate([key, _and_one(p["E"] @ p["V"] @ p["O"])], 1)


def layout(net: Network, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' inputs behind one another, each after STRIDE pads and filled up to whole strides; the starts of all windows, and the text of each."""
    h = net.stride
    n = -(-size // h)
    begin = np.cumsum((n + 1) * h) - (n + 1) * h
    flat = np.full(int(((n + 1) * h).sum()), net.pad, np.int32)
    some = size > 0
    flat[begin[some] + h] = net.begin
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(symbols)) - np.repeat(np.cumsum(size) - size, size)
    inner = at + 1 < size[owner]
    flat[begin[owner[inner]] + h + 1 + at[inner]] = symbols[inner]
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return flat, begin[text] + k * h, text


def score(net: Network, rank: Ranking, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The negative log probability of each text, given all ids joined and the number of each text's."""
    out = np.zeros(len(size))
    if not len(ids):
        return out
    h = net.stride
    flat, start, text = layout(net, rank.symbol[ids], size)
    n = -(-size // h)
    first = np.cumsum(n) - n
    at = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
    target = np.full(len(start) * h, -1, np.int32)
    target[np.repeat(first * h, size) + at] = rank.outcome[ids]
    target = target.reshape(-1, h)
    p = net.p
    tq, tkv = net.tables()
    e = np.concatenate([p["E"], np.zeros((len(p["E"]), 1), np.float32)], 1)
    wb, uc = np.concatenate([p["W"], p["b"][None]]), np.concatenate([p["U"], p["c"][:, None]], 1)
    dist = _offsets(h)
    base = np.where(dist < 0, _NO, p["D"][np.maximum(dist, 0)])
    window, one = np.arange(2 * h), np.ones(int(net.wide.max()), np.float32)
    for i in range(0, len(start), _SCORED // h):
        t = slice(i, i + _SCORED // h)
        s = flat[start[t, None] + window]
        kv = tkv.take(s, 0)
        a = tq.take(s[:, h:], 0) @ kv[:, :, : net.width + 1].transpose(0, 2, 1)
        a += base
        y = target[t].ravel()
        there = np.flatnonzero(y >= 0)
        c = (_exp(a, a.reshape(-1, 2 * h)[there, h + there % h]) @ kv[:, :, net.width + 1 :]).reshape(-1, net.width + 1)
        order, cls, some, own, total, runs = net.by_class(y[there])
        there = there[order]
        o = c.take(there, 0)
        o /= o[:, -1:]
        o += e.take(s[:, h:].ravel()[there], 0)
        loss = _surprise(_rows(o, wb), cls)
        z, blocks = _logits(o, uc, total, runs)
        mine, sums = z.take(own), np.ones(len(o), z.dtype)
        if len(z) and (mine.min() < -_SAFE or z.max() > _SAFE):
            for (r, _, _, _), block in zip(runs, blocks):
                block -= block.max(-1, keepdims=True)
            mine = z.take(own)
        np.exp(z, out=z)
        for (r, _, _, _), block in zip(runs, blocks):
            np.matmul(block, one[: block.shape[1]], out=sums[r])
        loss[some] += np.log(sums[some]) - mine
        out += np.bincount(text[t][there // h], loss, len(out))
    return out - np.bincount(np.repeat(np.arange(len(size)), size), rank.given[ids], len(size))


def _surprise(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """-log softmax(z) at own, for each row."""
    mine = z.take(np.arange(len(z)) * z.shape[1] + own)
    if mine.min() < -_SAFE or z.max() > _SAFE:
        top = z.max(1)
        z -= top[:, None]
        mine -= top
    return np.log(_total(np.exp(z, out=z))) - mine


def training_windows(net: Network, rank: Ranking, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, outcomes and text numbers of the windows that tile the stream of texts, none of which is empty; each id is a target once."""
    w = 2 * net.stride
    size = np.array([len(x) for x in texts], np.int64)
    ids = np.concatenate(texts)
    n = -(-len(ids) // w) * w
    s, y, text = np.full(n, net.pad, np.uint16), np.full(n, -1, np.int16), np.full(n, -1, np.int32)
    s[1 : len(ids)] = rank.symbol[ids[:-1]]
    s[np.cumsum(size) - size] = net.begin
    y[: len(ids)] = rank.outcome[ids]
    text[: len(ids)] = np.repeat(np.arange(len(size)), size)
    return s.reshape(-1, w), y.reshape(-1, w), text.reshape(-1, w)


def _tokenize(raw):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.Vocabulary(raw.value)
        if len(vocab.sizes) > 1 << 16:
            raise ValueError("ids must fit in two bytes")
        for b in batches:
            for part in _slices(b, "t", _TEXT_BYTES):
                texts = part.column(1).to_pylist()
                flat, n = bpe.encode_texts([t for t in texts if t is not None], vocab)
                data, edge, k, out = flat.astype("<u2").tobytes(), np.r_[0, np.cumsum(n)] * 2, 0, []
                for t in texts:
                    out.append(None if t is None else data[edge[k] : edge[k + 1]])
                    k += t is not None
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return run


def _slices(b: pa.RecordBatch, col: str, most: int) -> Iterator[pa.RecordBatch]:
    """b in runs of rows with about ``most`` bytes in a column; a longer value is a run of its own."""
    size = np.array([0 if x is None else x for x in pc.binary_length(b.column(col)).to_pylist()], np.int64)
    run = np.cumsum(size) // most
    edge = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)] if len(run) else np.array([0])
    for x, y in zip(edge, edge[1:]):
        yield b.slice(int(x), int(y - x))


def _ids(b: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    for x in b.column("ids"):
        yield np.frombuffer(x.as_py(), "<u2").astype(np.int64) if x.is_valid else None


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            for ids in _ids(b):
                if ids is not None:
                    n += np.bincount(ids, minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["id", "n"])

    return run


def _train(given, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, rank = given.value
        found = [ids for b in batches for ids in _ids(b) if len(ids)]
        if not found:
            return
        s, y, text = training_windows(net, rank, found)
        found.clear()
        own = net.copy()
        own.train(s, y, text, rate)
        w, v = len(s), own.vector().astype(float)
        parts = np.array_split(v * w, _PARAM_BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARAM_BLOCKS), pa.int64()), pa.array([float(w)] * _PARAM_BLOCKS), pa.array([x.tolist() for x in parts], pa.list_(pa.float64()))], ["k", "w", "v"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks; rows come sorted, so the sum doesn't depend on the order of tasks."""
    total: dict[int, list] = {}
    for b in batches:
        for k, w, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            own = total.setdefault(k, [0.0, 0.0])
            own[0] += w
            own[1] = own[1] + np.array(v.as_py())
    keys = sorted(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([(total[k][1] / total[k][0]).tolist() for k in keys], pa.list_(pa.float64()))], ["k", "v"])


def fit(tokens: DataFrame, size: int, rounds: int = ROUNDS) -> tuple[Network, Ranking]:
    """Counts and trains over tokens (ids); size is that of the vocabulary."""
    sc = tokens.sparkSession.sparkContext
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(lean(_count(size)), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row an id of the vocabulary
        counts[r.id] = r.n
    rank = Ranking(counts)
    net = Network(rank)
    shards = max(1, round(int(counts.sum()) / SHARD_IDS))
    rows = tokens.select("doc_id", "ids").where("ids is not null").distinct().select(F.xxhash64("doc_id", "ids").alias("h"), "ids")
    dealt = rows.repartition(shards, "h").sortWithinPartitions("h", "ids").select("ids")
    for i in range(rounds):
        trained = dealt.mapInArrow(lean(_train(sc.broadcast((net, rank)), _RATE / 2**i)), "k bigint, w double, v array<double>")
        mean = trained.repartition(min(parts, _PARAM_BLOCKS), "k").sortWithinPartitions("k", "w", "v").mapInArrow(lean(_average), "k bigint, v array<double>").collect()
        if mean:
            net.take(np.concatenate([np.array(r.v) for r in sorted(mean, key=lambda r: r.k)]))
    return net, rank


def _score(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, rank = given.value
        for b in (part for batch in batches for part in _slices(batch, "ids", _ID_BYTES)):
            found = list(_ids(b))
            size = np.array([0 if x is None else len(x) for x in found], np.int64)
            nll = score(net, rank, np.concatenate([np.zeros(0, np.int64), *[x for x in found if x is not None]]), size)
            null = np.array([x is None for x in found], bool)
            bits = nll / np.log(2) / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, mask=null), pa.array(nll, mask=null), pa.array(bits, mask=null | (size == 0))], ["doc_id", "n_tokens", "nll", "bits"])

    return run


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.VOCABULARY) -> tuple[DataFrame, int]:
    """(doc_id, ids), two bytes an id, and the size of the vocabulary."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    held = docs.sparkSession.sparkContext.broadcast(raw)
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return d.mapInArrow(lean(_tokenize(held)), "doc_id bigint, ids binary"), len(bpe.Vocabulary(raw).sizes)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, nll, bits): the negative log likelihood of each text in nats, and bits per token, by the model fitted to all texts."""
    tokens, size = tokenize(docs, id_col, text_col, vocabulary)
    tokens = cut(tokens)
    given = docs.sparkSession.sparkContext.broadcast(fit(tokens, size))
    return tokens.mapInArrow(lean(_score(given)), "doc_id bigint, n_tokens bigint, nll double, bits double")
