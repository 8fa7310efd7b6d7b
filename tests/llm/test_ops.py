"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from glossa.llm import audio, bm25, bpe, chat, common, langid, licenses, lm, mixing, simhash, substrings

g = random.Random(7)
VOCAB = ["".join(g.choice("abcdefghijklmnopqrstuvwxyzäéß") for _ in range(g.randint(2, 9))) for _ in range(600)]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(n: int, rng: random.Random) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, "   ", None), (4, "word", "b"), (5, "word", "b"), (5, "word", "b"), (None, "some text of no id", "a"), (6, "lang " * 30000, "a")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, prose(rng.randint(20, 220), rng), f"s{i % 3}") for i in range(120)]
    for i in range(120, 150):  # near copies
        words = rows[i - 120][1].split()
        for k in range(0, len(words), 25):
            words[k] = rng.choice(VOCAB)
        rows.append((i, " ".join(words), "s0"))
    for i in range(150, 160):
        rows.append((i, rows[5][1], "s1"))
    passage = prose(70, rng)
    for i in range(160, 172):
        w = passage.split()
        if i % 2:
            w[30] = "edited"
            w.insert(50, "more")
        rows.append((i, prose(60, rng) + " " + " ".join(w) + " " + prose(60, rng), "s2"))
    return rows


# 1


def test_bm25_equals_brute_force(spark, corpus):
    import math

    q = [(i, prose(8, random.Random(i)) + " " + corpus[i][1][:60]) for i in range(15)] + [(99, None), (None, "x"), (98, ""), (97, "zzzzzz"), (3, VOCAB[0])]
    got = defaultdict(list)
    for r in bm25.search(spark.createDataFrame(q, "item_id bigint, text string"), docs(spark, corpus)).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    words = {i: common.WORD.findall(t.lower()) for i, t, _ in corpus}
    df = Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    for i in [*range(15)]:
        text = q[i][1] if i != 3 else " ".join(sorted({q[3][1], VOCAB[0]}))
        c = Counter(common.WORD.findall(text.lower()))
        scores = []
        for d, ws in words.items():
            tf = Counter(ws)
            s = sum(n * math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, n in c.items() if tf[w])
            if s > 0:
                scores.append((-round(s, 6), d))
        want = [(k + 1, d, -s) for k, (s, d) in enumerate(sorted(scores)[:10])]
        assert [(k, d) for k, d, _ in sorted(got[i])] == [(k, d) for k, d, _ in want]
        assert np.allclose([s for *_, s in sorted(got[i])], [s for *_, s in want], atol=2e-6)
    assert not {97, 98, 99} & got.keys()


def test_bm25_odd_and_many_shards(spark, corpus, monkeypatch):
    q = spark.createDataFrame([(1, "word text")], "item_id bigint, text string")
    found = [(r.doc_id, r["rank"]) for r in bm25.search(q, docs(spark, ODD)).orderBy("rank").collect()]
    assert found == [(4, 1), (5, 2), (5, 3)]
    assert bm25.search(q, docs(spark, [])).count() == 0
    assert bm25.search(q.limit(0), docs(spark, ODD)).count() == 0
    q = spark.createDataFrame([(i, corpus[i][1][:80]) for i in range(20)], "item_id bigint, text string")
    one = sorted(map(tuple, bm25.search(q, docs(spark, corpus)).collect()))
    monkeypatch.setattr(bm25, "QUERY_BYTES", 400)
    assert sorted(map(tuple, bm25.search(q, docs(spark, corpus).repartition(7)).collect())) == one


def test_bm25_pruning_is_exact():
    rng = np.random.default_rng(0)
    n, terms = 3000, 30
    per = rng.integers(1, 12, n)
    t = np.concatenate([rng.choice(terms, k, replace=False) for k in per]).astype(np.int32)
    tf = rng.integers(1, 9, len(t)).astype(np.int32)
    idf = rng.random(terms) * 5
    s = bm25.Shard(np.arange(n), per * 10, per, t, tf, idf, 60.0, 1.2, 0.75)
    owner = np.repeat(np.arange(n), per)
    impact = idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * per[owner] * 10 / 60))
    for seed in range(40):
        query = [(int(x), int(c)) for x, c in zip(rng.choice(terms, 6, replace=False), rng.integers(1, 3, 6))]
        full = np.zeros(n)
        for x, c in query:
            m = t == x
            full[owner[m]] += c * impact[m]
        full = np.round(full, 6)
        want = np.lexsort((np.arange(n), -full))[:10]
        ids, scores = s.top(query, 10)
        assert np.allclose(scores, full[want], atol=2e-6) and set(ids) == set(want)


# 2


def test_simhash_search_is_exhaustive():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    f = np.concatenate([base ^ (sum((np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(0)) if k == 0 else np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (k, 60)).astype(np.uint64), axis=0)) for k in (0, 3, 6, 9, 10)])
    want = {(a, b) for a in range(len(f)) for b in range(a + 1, len(f)) if int(f[a] ^ f[b]).bit_count() <= simhash.K}
    for many in (False, True):
        found = set()
        for m, masks in simhash.tables(many):
            for inner in masks:
                for a, b in simhash.close_pairs(f & np.uint64(m | inner), f, simhash.K):
                    found |= {tuple(sorted((int(x), int(y)))) for x, y in zip(a, b)}
        assert found == want


def test_simhash_search_with_pruning_and_blocks(monkeypatch):
    """Components of a ball of near copies among other rows are those of all pairs, whatever the sizes of pieces."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    flip = lambda x, k: x ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (k, len(x))).astype(np.uint64), axis=0)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    f = np.concatenate([flip(np.repeat(base, 700), 4), rng.integers(0, 2**63, 300, dtype=np.uint64)])
    f = np.unique(np.concatenate([f, flip(f[650:850], 6)]))
    g = np.where(rng.random(len(f)) < 0.5, np.uint64(0), np.uint64(2**40 - 1))
    parent = simhash._Union(len(f))
    near = (np.bitwise_count(f[:, None] ^ f[None]) <= simhash.K) & (np.bitwise_count(g[:, None] ^ g[None]) <= simhash.VERIFY)
    parent.join(*np.nonzero(near))
    want = parent.roots()
    for many, front, rows in ((False, 2_000_000, 100_000), (False, 640, 100), (True, 640, 100)):
        monkeypatch.setattr(simhash, "_FRONT", front)
        monkeypatch.setattr(simhash, "_ROWS", rows)
        masks = simhash.tables(many)
        t, key = np.repeat(np.arange(len(masks)), len(f)), np.concatenate([f & np.uint64(m) for m, _ in masks]).view(np.int64)
        order = np.lexsort((key, t))
        cols = [t.astype(np.int32), key, *(np.tile(x, len(masks)) for x in (f.view(np.int64), g.view(np.int64), np.arange(len(f))))]
        table = pa.table({n: c[order] for n, c in zip(("t", "key", "f", "g", "node"), cols)})
        union = simhash._Union(len(f))
        for b in simhash._search(simhash.K, simhash.VERIFY, masks)(iter(table.to_batches(max_chunksize=70))):
            union.join(*(c.to_numpy() for c in b.columns))
        assert (union.roots() == want).all()


def test_simhash_groups(spark, corpus):
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs(spark, corpus)).collect()}
    assert {got[i] for i in range(150, 160)} == {5}
    assert sum(got[i] == got[i - 120] for i in range(120, 150)) >= 27
    f = {i: simhash.fingerprint(t) for i, t, _ in corpus}
    parent = {i: i for i in f}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(f)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = f[a], f[b]
            m = 2**64 - 1
            if ((x[0] ^ y[0]) & m).bit_count() <= simhash.K and ((x[1] ^ y[1]) & m).bit_count() <= simhash.VERIFY:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    assert got == {i: root(i) for i in ids}


def test_simhash_odd(spark):
    d = docs(spark, ODD)
    got = sorted(map(tuple, simhash.near_duplicates(d).collect()))
    assert got == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True)]
    kept = simhash.deduplicate(d.withColumnRenamed("lang", "group_id").withColumnRenamed("source", "node"))
    assert kept.columns == ["doc_id", "text", "group_id", "node", "n_chars"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, None])
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.deduplicate(docs(spark, [])).count() == 0


def test_simhash_repeated_ids(spark, corpus):
    a, b, c = (corpus[i][1] for i in (1, 2, 3))
    d = docs(spark, [(7, a, "x"), (7, b, "x"), (7, a, "x"), (8, b, "y"), (6, c, "x"), (6, c, "y"), (6, c, "y"), (9, "", "x"), (9, None, "x"), (10, a, "x")]).withColumnRenamed("lang", "h").withColumnRenamed("source", "i")
    assert sorted(map(tuple, simhash.near_duplicates(d).collect())) == [(6, 6, True), (7, 7, True), (8, 7, False), (9, 9, True), (10, 7, False)]
    kept = sorted((tuple(r) for r in simhash.deduplicate(d).collect()), key=str)
    assert sorted((r[0], r[1] or "") for r in kept) == sorted([(6, c), (7, a), (7, b), (9, "")])
    assert kept == sorted((tuple(r) for r in simhash.deduplicate(d.repartition(3)).collect()), key=str)


def test_simhash_sorts_each_four_blocks_once():
    """In one bucket, so that no pair is searched twice, and none of the four blocks of either half is left out."""
    for many in (False, True):
        fours = [bucket | own for bucket, sorts in simhash.tables(many) for own in sorts]
        width = 32 // simhash.BLOCKS
        want = {sum(((1 << width) - 1) << half + width * b for b in c) for half in (0, 32) for c in combinations(range(simhash.BLOCKS), 4)}
        assert len(fours) == len(set(fours)) == 140 and set(fours) == want


# 3


def test_licenses_equal_brute_force(spark, corpus):
    rng = random.Random(5)
    names = sorted(licenses.TEMPLATES)
    rows = []
    for i, (d, t, s) in enumerate(corpus[:60]):
        w = t.split()
        piece = licenses.TEMPLATES[names[i % len(names)]].split()
        if i % 3 == 0 and len(piece) > 8:
            piece[4] = "other"
        k = rng.randrange(len(w))
        rows.append((d, " ".join(w[:k] + piece + w[k:]), s))
    got = Counter((r.doc_id, r.template, r.start_word, r.end_word, round(r.containment, 6)) for r in licenses.matches(docs(spark, rows)).collect())
    want = Counter()
    for d, t, _ in rows:
        words = common.word_hashes(t)
        h = common.shingle_hashes(words, 2).tolist()
        for n in names:
            tw = common.word_hashes(licenses.TEMPLATES[n])
            own, m, places, taken = set(common.shingle_hashes(tw, 2).tolist()), len(tw), [], []
            for p in range(len(h)):
                c = len(set(h[p : p + m - 1]) & own) / len(own)
                if c >= licenses.LEAST:
                    places.append((-c, p))
            for c, p in sorted(places):
                if all(abs(p - q) >= m for q in taken):
                    taken.append(p)
                    want[d, n, p, min(p + m, len(words)), round(-c, 6)] += 1
    assert sum((got & want).values()) >= 0.98 * sum(want.values()) and not got - want and len(want) > 30


def test_licenses_odd(spark):
    assert licenses.matches(docs(spark, ODD)).count() == 0
    line = licenses.TEMPLATES["mit-line"]
    d = docs(spark, [(1, line, "a"), (1, line, "a"), (None, line, "a"), (2, "x " * 50000 + line, "a")])
    assert sorted((r.doc_id, r.start_word) for r in licenses.matches(d).collect()) == [(1, 0), (1, 0), (2, 50000)]
    assert licenses.matches(docs(spark, [])).count() == 0


# 4


@pytest.fixture(scope="module")
def vocab():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.Vocabulary(f.read())


def _chains(vocab, n, size, seed=2):
    """Encoded texts in which each word has two followers."""
    rng = random.Random(seed)
    words = VOCAB[:40]
    follow = {w: rng.sample(words, 2) for w in words}
    out = []
    for _ in range(n):
        w, text = rng.choice(words), []
        for _ in range(size):
            text.append(w)
            w = rng.choice(follow[w])
        out.append(bpe.encode_texts([" ".join(text)], vocab)[0].astype(np.int64))
    return out


def test_lm_gradients(vocab):
    ids = _chains(vocab, 6, 60)
    rank = lm.Ranking(np.bincount(np.concatenate(ids), minlength=len(vocab.sizes)), out=40)  # so that some outcomes are tails
    net = lm.Network(rank)
    s, y, text = (x.astype(np.int64) for x in lm.training_windows(net, rank, ids))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    cls = net.of[y[:4][y[:4] >= 0]]
    big = next(c for c in cls if net.edge[c + 1] - net.edge[c] > 1)
    _, grad = net.loss(s[:4], y[:4], text[:4])
    for k in net.p:
        at = {"E": (int(s[0, -1]), 1), "U": (int(net.edge[big]), 1), "c": (int(net.edge[big]),), "D": (3,)}.get(k, tuple(x // 2 for x in net.p[k].shape))
        e, old = 1e-4, net.p[k][at]
        net.p[k][at] = old + e
        up = net.loss(s[:4], y[:4], text[:4])[0]
        net.p[k][at] = old - e
        down = net.loss(s[:4], y[:4], text[:4])[0]
        net.p[k][at] = old
        assert abs(grad[k][at] - (up - down) / 2 / e) < 1e-5 and abs(up - down) > 0


def test_lm_blocks_and_shifts(vocab):
    ids = _chains(vocab, 40, 60)
    rank = lm.Ranking(np.bincount(np.concatenate(ids), minlength=len(vocab.sizes)), out=40)
    net = lm.Network(rank)
    s, y, text = (x.astype(np.int64) for x in lm.training_windows(net, rank, ids))
    d, size = np.concatenate(ids), np.array([len(x) for x in ids])
    loss, grad = net.loss(s, y, text)
    nll = lm.score(net, rank, d, size)
    # classes that share a product give what each class alone gives, in fewer products
    alone = lm.Network(rank, block=1)
    assert all(last == first + 1 and (u.start, u.stop) == tuple(net.edge[first : last + 1]) for first, last, u, _ in alone.blocks)
    assert 2 * len(net.blocks) < len(alone.blocks) and {c for x in alone.blocks for c in range(x[0], x[1])} <= {c for x in net.blocks for c in range(x[0], x[1])}
    # a softmax doesn't change with a number added to all its logits, however large
    nets = [alone]
    for k in ("b", "c", "D"):
        for by in (-200, 200):
            nets.append(net.copy())
            nets[-1].p[k] += np.float32(by)
    for other in nets:
        got, g = other.loss(s, y, text)
        assert abs(got / loss - 1) < 1e-4 and all(np.allclose(g[k], grad[k], rtol=1e-2, atol=1e-5) for k in grad)
        assert np.allclose(lm.score(other, rank, d, size), nll, rtol=1e-4)


def test_lm_runs_of_rows(vocab, monkeypatch):
    rng = np.random.default_rng(4)
    for n in (0, 1, 6, 7, 20, 28):  # products in runs of 7 rows, with and without a rest, also of a transposed matrix
        x, m, z = rng.normal(size=(n, 3)), rng.normal(size=(3, 5)), rng.normal(size=(n, 4))
        monkeypatch.setattr(lm, "_RUN", 7)
        assert np.allclose(lm._rows(x, m), x @ m)
        assert np.allclose(lm._rows(np.asfortranarray(x), m, np.empty((n, 5))), x @ m) and np.allclose(lm._across(x, z), x.T @ z)
    ids = _chains(vocab, 40, 60)
    d, size = np.concatenate(ids), np.array([len(x) for x in ids])
    rank = lm.Ranking(np.bincount(d, minlength=len(vocab.sizes)), out=40)
    for block in (1, 32):  # rows of classes of one outcome are in no block, or in one
        net = lm.Network(rank, block=block)
        s, y, text = (x.astype(np.int64) for x in lm.training_windows(net, rank, ids))
        y[::5] = -1  # some inputs have no outcome
        got = []
        for run in (7, 1 << 30):
            monkeypatch.setattr(lm, "_RUN", run)
            got.append((*net.loss(s, y, text), lm.score(net, rank, d, size)))
        assert abs(got[0][0] / got[1][0] - 1) < 1e-5 and np.allclose(got[0][2], got[1][2], rtol=1e-5)
        assert all(np.allclose(got[0][1][k], v, rtol=1e-3, atol=1e-6) for k, v in got[1][1].items())
        # the logits within classes: each row has those of its block, and its own outcome's is at its place
        order, cls, some, at, total, runs = net.by_class(rank.outcome[d])
        assert (cls == net.of[rank.outcome[d][order]]).all() and total == net.wide[cls].sum() and (at < total).all()
        assert sorted(some) == [i for i, c in enumerate(cls) if net.wide[c]] and sum(b.stop - b.start for _, _, b, _ in runs) == total
        none = np.full_like(y, -1)
        loss, grad = net.loss(s, none, text)
        assert loss == 0 and not any(g.any() for g in grad.values())


def test_lm_gain_and_brute_force(vocab):
    ids = _chains(vocab, 340, 300)
    counts = np.bincount(np.concatenate(ids[:300]), minlength=len(vocab.sizes))
    rank = lm.Ranking(counts, out=60)
    net = lm.Network(rank)
    held, size = np.concatenate(ids[300:]), np.array([len(x) for x in ids[300:]])
    unigram = -np.log((counts[held] + 1) / (counts + 1).sum()).sum()
    assert abs(lm.score(net, rank, held, size).sum() / unigram - 1) < 0.02  # begins as the counts
    net.train(*lm.training_windows(net, rank, ids[:300]))
    assert lm.score(net, rank, held, size).sum() < 0.8 * unigram
    # id by id: over its window's context, the probabilities of all outcomes
    p, h = {k: v.astype(float) for k, v in net.p.items()}, net.stride
    for d in (ids[301], ids[302][:1], ids[303][:16], ids[304][:17], ids[305][:45]):
        inputs, total = [net.begin, *rank.symbol[d[:-1]]], 0.0
        for t in range(len(d)):
            first = max(0, t // h * h - h)
            x = p["E"][inputs[first : t + 1]]
            a = (x @ p["K"]) @ (x[-1] @ p["Q"]) / net.width**0.5 + p["D"][np.arange(len(x))[::-1]]
            a = np.exp(a - a.max())
            o = x[-1] + (a / a.sum()) @ (x @ p["V"]) @ p["O"]
            z = o @ p["W"] + p["b"]
            out = np.empty(len(net.of))
            for c in range(len(z)):
                e = np.exp(p["U"][net.edge[c] : net.edge[c + 1]] @ o + p["c"][net.edge[c] : net.edge[c + 1]])
                out[net.edge[c] : net.edge[c + 1]] = e / e.sum() * np.exp(z[c]) / np.exp(z).sum()
            assert abs(out.sum() - 1) < 1e-9
            total -= np.log(out[rank.outcome[d[t]]]) + rank.given[d[t]]
        assert abs(total - lm.score(net, rank, d, np.array([len(d)]))[0]) < 1e-3 * len(d)


def test_lm_probabilities_sum_to_one():
    for classes, out in ((64, 4096), (8, 20), (5, 1), (3, 200)):
        counts = np.random.default_rng(0).zipf(1.3, 200) % 5000
        rank = lm.Ranking(counts, classes=classes, out=out)
        p = np.exp(rank.given + rank.share[rank.outcome] + rank.prior[rank.cls])
        assert np.allclose(p, (counts + 1) / (counts + 1).sum(), rtol=1e-4) and (rank.of[rank.outcome] == rank.cls).all()


def test_lm_trains_on_every_id(vocab):
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, len(vocab.sizes), n) for n in (1, 15, 16, 17, 3000, 1, 31, 32, 33)]
    rank = lm.Ranking(np.bincount(np.concatenate(texts), minlength=len(vocab.sizes)))
    net = lm.Network(rank)
    s, y, text = (x.ravel() for x in lm.training_windows(net, rank, texts))
    assert y[y >= 0].tolist() == rank.outcome[np.concatenate(texts)].tolist()
    for k, t in enumerate(texts):
        assert s[text == k].tolist() == [net.begin, *rank.symbol[t[:-1]]]


def test_lm_same_under_any_layout(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_IDS", 20_000)
    rows = corpus + [(None, "no id", "a"), (None, "no id", "a"), (5, corpus[5][1], "b")]
    one = sorted(map(tuple, lm.score_corpus(docs(spark, rows).coalesce(1)).collect()), key=str)
    d = docs(spark, rows[::-1]).repartition(7).withColumnRenamed("lang", "ids").withColumnRenamed("source", "h").withColumnRenamed("n_chars", "bits")
    two = sorted(map(tuple, lm.score_corpus(d).collect()), key=str)
    assert [r[:2] for r in one] == [r[:2] for r in two] and np.allclose([r[2] for r in one], [r[2] for r in two], rtol=1e-6)


def test_lm_odd(spark):
    got = {(r.doc_id, r.n_tokens) for r in lm.score_corpus(docs(spark, ODD)).where("doc_id < 3").collect()}
    assert got == {(1, None), (2, 0)}
    d = lm.score_corpus(docs(spark, ODD)).collect()
    assert len(d) == len(ODD) and all(r.bits is not None and r.bits > 0 for r in d if r.n_tokens)
    assert lm.score_corpus(docs(spark, [])).count() == 0


# 5


def test_chain_equals_quadratic():
    rng = random.Random(4)
    for _ in range(60):
        seg = []
        for _ in range(rng.randint(1, 14)):
            x, y, n = rng.randint(0, 90), rng.randint(0, 90), rng.randint(6, 18)
            seg.append((x, x + n, y, y + n))
        order = sorted(seg)
        score = []
        for i, (x0, x1, y0, y1) in enumerate(order):
            best = max([0.0] + [score[j] - 0.25 * ((x0 - s[1]) + (y0 - s[3])) for j, s in enumerate(order[:i]) if s[1] <= x0 + 6 and s[3] <= y0 + 6])
            score.append(x1 - x0 + best)
        got = substrings.chain(seg, max_gap=10**9)
        first = got[0]
        value = first[0][1] - first[0][0]
        for s, t in zip(first, first[1:]):
            value += t[1] - t[0] - 0.25 * ((t[0] - s[1]) + (t[2] - s[3]))
        assert abs(value - max(score)) < 1e-9
        assert sorted(s for c in got for s in c) == order


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert substrings.lcs(a, b) == t[-1][-1]


def test_passages(spark, corpus):
    got = substrings.passages(docs(spark, corpus)).collect()
    shared = {r.doc_id for r in got if r.other_id == 160}
    assert shared == set(range(161, 172))
    for r in got:
        if r.other_id == 160:
            assert 58 <= r.passage_start <= 62 and 128 <= r.passage_end <= 134
    ids, long = {r.doc_id for r in got}, {i for i, t, _ in corpus if len(t.split()) >= 56}
    assert ids <= set(range(120, 160)) | set(range(161, 172)) and ids >= (set(range(120, 160)) & long) | set(range(161, 172))  # copies, near copies, sharers; nothing else
    out = {r.doc_id: r.text for r in substrings.remove(docs(spark, corpus), length_col="n_chars").collect()}
    assert out[160] == corpus[160][1] and (159 in out) == (159 not in long) and out[7] == corpus[7][1]
    left = out[161].split()
    assert 118 <= len(left) <= 124 and left[:55] == corpus[161][1].split()[:55]


def test_passages_recall(spark):
    """Of passages with an aligned run of at least 50 words and identity 0.75, bounded by matches, at least 0.9 are found at each length and rate of edits."""
    rng = np.random.default_rng(11)
    word = lambda n: rng.integers(0, 3000, n)
    rows, grade = [], {}
    for words, edits in ((50, 0.03), (60, 0.05), (60, 0.08), (60, 0.1), (80, 0.08), (80, 0.1), (100, 0.12)):
        for _ in range(60):
            p = word(words)
            a, b = (np.where(rng.random(words) < edits, word(words), p) for _ in range(2))
            at = np.flatnonzero(a == b)
            if any(j - i + 1 >= substrings.MIN_WORDS and (y - x + 1) >= substrings.IDENTITY * (j - i + 1) for x, i in enumerate(at) for y, j in enumerate(at)):
                for body in (a, b):
                    rows.append((len(rows), " ".join(f"w{x}" for x in np.r_[word(70), body, word(80)]), "a"))
                grade[len(rows) - 1] = words, edits
    found = {r.doc_id for r in substrings.passages(docs(spark, rows)).collect() if r.doc_id == r.other_id + 1 and r.passage_start < 70 + 25 and r.passage_end > 70 + 25}
    assert found <= grade.keys()
    for g in set(grade.values()):
        own = [d for d in grade if grade[d] == g]
        assert len(found & set(own)) >= 0.9 * len(own), g


@pytest.mark.parametrize("window, chunk", [(1, 1 << 20), (1, 500), (4, 500)])
def test_seeds_of_one_document_are_not_shuffled(spark, corpus, monkeypatch, window, chunk):
    """Of all seeds those go to the shuffle that several documents have, all of them, in one chunk or in several."""
    import pyarrow as pa

    monkeypatch.setattr(substrings, "_CHUNK_WORDS", chunk)
    codes = [(i, (common.word_hashes(t) >> np.uint64(32)).astype("<u4").tobytes()) for i, t, _ in corpus] + [(900, b""), (901, b"\1\2\3\4" * 5000), (902, b"\1\2\3\4" * 5), (903, b"\1\2\3\4" * 7)]
    monkeypatch.setattr(substrings.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    batch = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*codes)], ["d", "codes"])
    schema = "chunk bigint, d array<bigint>, n array<int>, vocab binary, data binary"
    made = [r for b in substrings._chunks(iter([batch])) for r in b.to_pylist()]
    assert (len(made) > 5) == (chunk == 500)
    chunks = spark.createDataFrame([[r[c] for c in ("chunk", "d", "n", "vocab", "data")] for r in made], schema)
    back = {d: c for b in substrings._rows(iter([pa.RecordBatch.from_pylist(made, pa.schema([("chunk", pa.int64()), ("d", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("vocab", pa.binary()), ("data", pa.binary())]))])) for d, c in zip(*(c.to_pylist() for c in b.columns))}
    assert back == {d: (np.frombuffer(c, "<u4") >> 16).astype("<u2").tobytes() for d, c in codes}
    every = []
    for d, c in codes:
        h = common.shingle_hashes(np.frombuffer(c, "<u4").astype(np.uint64), 6) if len(c) >= 24 else np.zeros(0, np.uint64)
        every += [(int(h[p : p + 1].view(np.int64)[0]), d, int(p)) for p in substrings._minimizers(h, window)]
    owners = {}
    for h, d, _ in every:
        owners.setdefault(h, set()).add(d)
    want = Counter(s for s in every if len(owners[s[0]]) > 1)
    got = Counter(tuple(r) for r in substrings.shared_seeds(chunks, 6, window).collect())
    assert 0 < len(want) < len(every) and got == want


def test_pipeline_stage_shuffles_no_seed_of_one_document(spark, monkeypatch):
    import corpus_pipeline

    sent, own = [], substrings.shared_seeds

    def counted(*a):
        out = own(*a)
        sent.append(out.count())
        return out

    monkeypatch.setattr(substrings, "shared_seeds", counted)
    rng = random.Random(12)
    alone = [(i, prose(100, rng), "a") for i in range(40)]
    assert corpus_pipeline.passages(spark, docs(spark, alone), "").count() == 40
    assert corpus_pipeline.passages(spark, docs(spark, [*alone, (40, alone[3][1], "a")]), "").count() == 40
    assert sent == [0, 2 * 95]


def test_words_of_equal_short_codes_are_no_passage(spark):
    """Two words whose hashes agree in their upper 16 bits: a text of one shares no passage with a text of the other."""
    by: dict[int, str] = {}
    pair = next((by[c], w) for w in (f"w{i}" for i in range(100_000)) for c in [int(common.word_hashes(w)[0] >> np.uint64(48))] if by.setdefault(c, w) != w)
    rows = [(1, " ".join([pair[0]] * 200), "a"), (2, " ".join([pair[1]] * 200), "a"), (3, " ".join([pair[0]] * 200), "a")]
    assert {(r.doc_id, r.other_id) for r in substrings.passages(docs(spark, rows)).collect()} == {(3, 1)}


def test_links_over_batches():
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.randint(0, 5), rng.randint(0, 4), rng.randint(0, 50)) for _ in range(200))
    want = Counter()
    for h in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == h]
        head = [r[2] for r in own if r[1] == own[0][1]]
        rank = Counter()
        for _, d, p in own:
            if d != own[0][1]:
                for q in {min(rank[d], len(head) - 1), 0}:
                    want[d, own[0][1], p - head[q], p] += 1
            rank[d] += 1
    for step in (1, 3, 17, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[i : i + step]), (pa.int64(), pa.int64(), pa.int32()))], ["h", "d", "p"]) for i in range(0, 200, step)]
        got = Counter(r for b in substrings._link(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns)))
        assert got == want


def test_passages_odd(spark):
    d = docs(spark, [*ODD, (7, "lang " * 30000, "b")]).withColumnRenamed("lang", "spans").withColumnRenamed("source", "d")
    kept = substrings.remove(d)
    assert kept.columns == ["doc_id", "text", "spans", "d", "n_chars"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 5, None, 6])
    assert substrings.remove(docs(spark, [])).count() == 0


# 6


def _bit_errors(p, q):
    """The least share of differing bits over all offsets with enough overlap."""
    best = 1.0
    for off in range(audio.OVERLAP - len(q), len(p) - audio.OVERLAP + 1):
        x, y = p[max(0, off) :], q[max(0, -off) :]
        n = min(len(x), len(y))
        if n >= audio.OVERLAP:
            best = min(best, np.bitwise_count(x[:n] ^ y[:n]).sum() / 32 / n)
    return best


def _recordings():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 64))
    near = base[:12] + rng.normal(size=(12, 64)) * 0.05
    late = np.concatenate([rng.normal(size=(6, 16)), base[:6, :48]], 1)
    rows = [(i, audio.render(v)) for i, v in enumerate(np.concatenate([base, near, late]))]
    rows += [(60 + k, audio.render(np.r_[base[20], rng.normal(size=k)])) for k in (9, 8, 30)]
    rows += [(70 + k, audio.render(np.zeros(24 + 3 * k))) for k in range(10)]  # constant tones of different lengths
    rows += [(80, audio.render(rng.normal(size=3000)))]
    rows += [(81, audio.render(np.r_[base[21], rng.normal(size=2000), base[22]]))]
    return rows


@pytest.mark.parametrize("hot", [8192, 5])
def test_audio(spark, monkeypatch, hot):
    monkeypatch.setattr(audio, "HOT", hot)
    rows = _recordings()
    copies = [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, b""), (104, b"junk"), (None, rows[0][1]), (105, rows[0][1][:400]), (50, rows[50][1]), (2, rows[1][1][:700])]
    d = spark.createDataFrame([(i, m, "x", 1) for i, m in rows + copies], "id bigint, media binary, print string, head int")
    out = {r.id: r for r in audio.align(d, "id", "media").collect()}
    prints = {i: audio.fingerprint(audio.chroma(*audio.decode(m))) for i, m in rows}
    folded = {}
    for i, p in prints.items():
        folded.setdefault(p.tobytes(), i)
    heads = sorted(folded.values())
    want = {(i, j) for n, i in enumerate(heads) for j in heads[n + 1 :] if _bit_errors(prints[i], prints[j]) <= audio.ERRORS}
    table = spark.createDataFrame([(i, prints[i].astype("<u4").tobytes()) for i in heads], "id bigint, print binary")
    got = {(r.id, r.other_id): r for r in audio.pairs(table).collect()}
    assert got.keys() <= want and len(got) >= 0.9 * len(want) and len(want) >= 60
    for (i, j), r in got.items():
        x, y = prints[i][max(0, r.offset) :], prints[j][max(0, -r.offset) :]
        n = min(len(x), len(y))
        assert r.overlap == n and r.errors == np.bitwise_count(x[:n] ^ y[:n]).sum() / 32 / n
    assert len(out) == len({i for i, _ in rows + copies if i is not None})
    for i in heads:
        links = [j for pair in got if i in pair for j in pair if j != i]
        assert out[i].links == len(links) and (out[i].nearest_id in links if links else out[i].nearest_id is None)
        assert all(out[j].group_id == out[i].group_id for j in links)
    assert out[3].copies == out[100].copies == out[101].copies == 2 and out[101].group_id == out[3].group_id and out[100].links == out[3].links
    assert all(out[i].links == 0 and out[i].copies == 0 and out[i].group_id == i for i in (102, 103, 104, 105))
    assert audio.align(d.limit(0), "id", "media").count() == 0


def test_audio_same_under_salting(spark, monkeypatch):
    d = spark.createDataFrame(_recordings(), "id bigint, media binary")
    one = sorted(map(tuple, audio.align(d, "id", "media").collect()), key=str)
    monkeypatch.setattr(audio, "HOT", 3)
    monkeypatch.setattr(audio, "_AT_ONCE", 50)
    assert sorted(map(tuple, audio.align(d.repartition(5), "id", "media").collect()), key=str) == one


def test_audio_recall_by_noise(spark):
    """Of pairs within ERRORS, noise graded from none to beyond it, 0.9 are found, and 0.95 of those within 0.15."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 64))
    noisy = base + rng.normal(size=base.shape) * rng.uniform(0.02, 0.4, 300)[:, None]
    prints = [audio.fingerprint(audio.chroma(*audio.decode(audio.render(v)))) for v in np.concatenate([base, noisy])]
    share = np.array([_bit_errors(prints[i], prints[300 + i]) for i in range(300)])
    table = spark.createDataFrame([(i, p.astype("<u4").tobytes()) for i, p in enumerate(prints)], "id bigint, print binary")
    got = {r.id for r in audio.pairs(table).collect() if r.other_id == r.id + 300}
    found = np.array([i in got for i in range(300)])
    assert found[share <= 0.15].mean() >= 0.95 and found[share <= audio.ERRORS].mean() >= 0.9 and (share <= audio.ERRORS).sum() > 100


# 7


def test_chat(spark):
    rng = random.Random(6)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 25)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", None])
            rows.append((c, t, role, None if rng.random() < 0.1 else prose(rng.choice([0, 3, 20, 60, 200]), rng)))
    rows += [(None, 1, "user", "x"), (900, None, "user", "first"), (900, 1, "assistant", "a"), (900, 1, "assistant", "a"), (901, 0, "system", "alone")]
    got = defaultdict(list)
    for r in chat.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect():
        got[r.conv_id].append(r)
    n = lambda t: len((t or "").split()) + 2
    for c in {r[0] for r in rows if r[0] is not None}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))
        head = next((x for x in own if x[2] == "system"), None)
        rest = [x for x in own if x is not head]
        room = chat.BUDGET - (n(head[3]) if head else 0)
        i, k = 0, 0
        found = sorted(got[c], key=lambda r: r.window)
        while i < len(rest):
            s = i
            while s > 0 and sum(n(x[3]) for x in rest[s - 1 : i]) <= min(chat.HISTORY, max(0, room - n(rest[i][3]))):
                s -= 1
            e = i + 1
            while e < len(rest) and sum(n(x[3]) for x in rest[s : e + 1]) <= room:
                e += 1
            r = found[k]
            assert (r.n_history, r.n_turns) == (i - s, e - i)
            assert r.targets == "0" * bool(head) + "".join("1" if j >= i and rest[j][2] == "assistant" else "0" for j in range(s, e))
            i, k = e, k + 1
        assert k == len(found)
    assert chat.windows(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


# 8


def test_langid(spark):
    a, b = [w for w in VOCAB if "e" in w][:60], ["zz" + w[::-1] + "o" for w in VOCAB[:60]]
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(30)), "xx" if i % 2 else "yy") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.fit(d.where("doc_id < 120"))
    got = {r.doc_id: r for r in langid.identify(d, net).collect()}
    assert np.mean([got[i].lang == l for i, _, l in rows if i >= 120]) > 0.95
    odd = docs(spark, [*ODD, (9, "0123 4567 89 " * 30, "a")]).withColumnRenamed("source", "_accepted")
    kept = langid.accept(odd, net)
    assert kept.columns == odd.columns and not {1, 2} & {r.doc_id for r in kept.collect()}
    assert langid.identify(docs(spark, []), net).count() == 0
    assert langid.fit(docs(spark, [])) is None and langid.accept(odd, None).count() == 0


def test_langid_equals_loop_over_bytes():
    """predict() against the network's equations, byte by byte, in float64; the state begins anew with each segment."""
    net = langid.Network(["a", "b", "und"], hidden=5, seed=3)
    p, h = {k: v.astype(float) for k, v in net.p.items()}, 5
    texts = [b"", b"x", prose(4, random.Random(1)).encode(), prose(60, random.Random(2)).encode(), bytes(range(256))]
    mean, count, size = langid.predict(net, texts)
    assert size.tolist() == list(map(len, texts)) and any(n > 2 * langid.SEGMENT for n in size)
    gate = lambda v: np.clip(0.25 * v + 0.5, 0, 1)
    for i, t in enumerate(texts):
        total, votes = np.zeros(3), np.zeros(3, int)
        for s in range(0, len(t), langid.SEGMENT):
            seg, states = t[s : s + langid.SEGMENT], {}
            for d in "fb":
                x, out = np.zeros(h), {}
                for k in range(len(seg)) if d == "f" else range(len(seg) - 1, -1, -1):
                    a, u = p["E" + d][seg[k]], x @ p["U" + d]
                    z, r = gate(a[:h] + u[:h]), gate(a[h : 2 * h] + u[h : 2 * h])
                    n = np.clip(a[2 * h :] + r * (u[2 * h :] + p["c" + d]), -1, 1)
                    x = out[k] = (1 - z) * n + z * x
                states[d] = out
            for k in range(len(seg)):
                e = np.exp(np.r_[states["f"][k], states["b"][k]] @ p["R"] + p["r"])
                total += e / e.sum()
                votes[e.argmax()] += 1
        assert np.allclose(mean[i], total / max(1, len(t)), atol=1e-5) and count[i].tolist() == votes.tolist()


def test_langid_rejects_noise_and_keeps_single_words(spark):
    """Noise of kinds that training makes, drawn anew, is rejected; rows of one clean word are kept. The share of each is asserted, as both are held-out."""
    rng, g = random.Random(8), np.random.default_rng(99)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(120)] for k, letters in (("xx", "aeilmnorst"), ("yy", "bdfghkpuwz"))}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["xx", "yy"] * 100)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    noise = [b.decode("latin-1") for b in langid._noise(g, 100)]
    single = [w for k in words for w in words[k][:50]]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(noise + single)], "doc_id bigint, text string")
    ok = {r.doc_id: r.accepted for r in langid.identify(d, net).collect()}
    assert np.mean([ok[i] for i in range(100)]) <= 0.05 and np.mean([ok[i] for i in range(100, 200)]) >= 0.95


def test_langid_gradient():
    net = langid.Network(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(0).integers(97, 105, (6, 4)), np.array([0, 1, 0, 1])
    _, grad = net.loss(x, y)
    for k in net.p:
        at = tuple(s // 2 for s in net.p[k].shape) if k[0] != "E" else (int(x[2, 1]), 2)
        e, old = 1e-5, net.p[k][at]
        net.p[k][at] = old + e
        up = net.loss(x, y)[0]
        net.p[k][at] = old - e
        assert abs(grad[k][at] - (up - net.loss(x, y)[0]) / 2 / e) < 1e-4
        net.p[k][at] = old


# 9


def test_bpe_equals_tiktoken(spark, corpus, vocab):
    import base64

    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*corpus, *[(None if i is None else i + 2000, t, s) for i, t, s in ODD], (1000, "naïve ½ ² 漢字   x\x1c y  \n\n z'll 12345 __a__ aaaaaaaaaaaaaaaa 🙂", "a")]
    got = defaultdict(list)
    for r in bpe.encode(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, t, _ in rows:
        for r in got[i]:
            if t is None:
                assert r.ids is None and r.n_tokens is None and r.round_trip is None
            else:
                assert r.ids == enc.encode_ordinary(t) and r.n_tokens == len(r.ids) and r.round_trip
                assert bpe.decode(r.ids, vocab) == t
    assert sum(map(len, got.values())) == len(rows)
    assert bpe.encode(docs(spark, [])).count() == 0


# 10


def test_mixing(spark, corpus):
    out = [tuple(r) for r in mixing.mix(docs(spark, corpus)).collect()]
    assert [r[4] for r in out] == sorted(r[4] for r in out)
    tokens = {i: len(t.split()) for i, t, _ in corpus}
    total = sum(tokens.values())
    source = {i: s for i, _, s in corpus}
    supply = Counter()
    for i, n in tokens.items():
        supply[source[i]] += n
    knots = [("s0", 0.0, 1.0), ("s0", 1.0, 0.0), ("s1", 0.0, 0.0), ("s1", 1.0, 1.0), ("s2", 0.0, 1.0)]
    out = mixing.mix(docs(spark, corpus), spark.createDataFrame(knots, "source string, t double, weight double"), total=2 * total).collect()
    used = Counter()
    for r in out:
        used[r.source] += r.n_tokens
    share = {s: [] for s in supply}
    for i in range(257):
        t = i / 256
        w = {"s0": 1 - t, "s1": t, "s2": 1.0}
        for s in share:
            share[s].append(w[s] / sum(w.values()))
    for s in share:
        want = 2 * total * np.trapezoid(share[s]) / 256
        assert abs(used[s] - want) <= 220
    first = [r.source for r in out if r.position < total / 20]
    assert first.count("s1") < len(first) / 5


def test_mixing_odd(spark):
    d = docs(spark, ODD).withColumnRenamed("lang", "position").withColumnRenamed("n_chars", "n")
    out = mixing.apply_mix(d)
    assert out.columns == d.columns
    assert {r.doc_id for r in out.collect()} <= {4, 5, 6, None}
    assert mixing.mix(docs(spark, [])).count() == 0


@pytest.mark.parametrize("run", [1, 50, 1 << 19])
def test_words_hashed_side_by_side(monkeypatch, run):
    """As one by one: letters of one to four bytes, words of all lengths, of another case's length, lone surrogates, empty texts."""
    rng = random.Random(4)
    parts = [chr(c) for c in [*range(32, 127)] * 3 + [0xDF, 0x130, 0x3A3, 0x3C2, 0x1F600, 0x10400, 0x4E2D, 0x300, 0xAD, 0xD800, 0x660, 0x2160, 10, 0, 0x2028, 0x10FFFF] * 6] + ["a" * n for n in (4, 7, 8, 9, 15, 16, 24, 31, 32, 33, 70)]
    texts = ["", *("".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(2000)), ""]
    monkeypatch.setattr(common, "_RUN_CHARS", run)
    got = common.all_word_hashes(texts)
    assert [x.tolist() for x in got] == [common.word_hashes(t).tolist() for t in texts]
    assert common.all_word_hashes([]) == []


def test_dedup_hashes_words_side_by_side(spark, corpus, monkeypatch):
    """The pipeline's near-dedup and substring dedup don't take the words of their documents one at a time."""
    import pandas as pd
    import pyarrow as pa

    texts = [t for _, t, _ in corpus]
    want = [simhash.fingerprint(t) for t in texts], [common.word_hashes(t) for t in texts]
    spans = [[{"s": 0, "e": 3}]] * len(texts)
    sigs = pd.Series([substrings.zlib.crc32((h >> np.uint64(48)).astype("<u2").tobytes()) for h in want[1]])

    def one_at_a_time(self, word):
        raise AssertionError(word)

    common._hashes.clear()
    monkeypatch.setattr(common._Hashes, "__missing__", one_at_a_time)
    ids = pa.array(range(len(texts)), pa.int64())
    got = next(simhash._fingerprints(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts), ids], ["id", "t", "h"])])))
    assert list(zip(got.column(2).to_pylist(), got.column(3).to_pylist())) == want[0]
    got = next(substrings._codes(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["d", "t"])])))
    assert got.column(1).to_pylist() == [(h >> np.uint64(32)).astype("<u4").tobytes() for h in want[1]]
    left = substrings._cut_all(pd.Series(texts), pd.Series(spans), sigs)
    assert left.tolist() == [" ".join(t.split()[3:]) for t in texts]


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    assert got == {x: root(x) for x in list(parent)}


def test_pipeline_odd(spark, corpus, tmp_path):
    """Each stage on nulls, empty and long texts, ties, repeated rows, extra columns with clashing names, and an empty table."""
    import corpus_pipeline

    d = docs(spark, corpus[:60] + ODD)
    for extra in ("id", "d", "h", "key", "position", "group_id", "_accepted", "spans"):
        d = d.selectExpr("*", f"concat('{extra} ', doc_id) AS {extra}")
    rows = Counter(map(str, d.collect()))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        kept = [r for r in out.collect()]
        assert all(r.id is None if r.doc_id is None else r.id == f"id {r.doc_id}" for r in kept), name
        if name in ("language ID", "SimHash near-dedup"):
            assert not Counter(map(str, kept)) - rows, name
        assert f(spark, d.limit(0), str(tmp_path)).count() == 0, name
    out = corpus_pipeline.tokens(spark, d, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in d.collect())
    assert corpus_pipeline.tokens(spark, d.limit(0), str(tmp_path)).count() == 0


def test_pipeline_stages(spark, corpus, tmp_path):
    import corpus_pipeline

    docs(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    d, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        d = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = d.count()
        if i < 4:
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept["language ID"] >= 0.98 * len(corpus)
    assert kept["SimHash near-dedup"] <= 135
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["byte-level BPE"] > 0
    assert all(r.round_trip for r in d.collect())
