import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from palimpsest.llm import quality as Q
from palimpsest.llm import queries

KINDS = [set(b"abcdefghijklmnopqrstuvwxyz"), set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set(b"0123456789"), set(b" \t\r\x0b\x0c"), set(b"\n"), set(b"!"), set(b"|"), set(b"%$&#*@^~=+<>_\\/{}[]"), set(b".,;:?"), set(b"\"'()-`"), set(range(0x80, 0x9F)), set(range(0x9F, 0xC0))]


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def plain_passages(data):
    """Features of the passages of a whole text, passage by passage."""
    if not data:
        return [[0.0] * Q.N_FEATURES]
    places, at = [], 0
    for line in data.split(b"\n"):
        line = data[at : at + len(line) + 1]
        places += [line[k : k + Q.PASSAGE] for k in range(0, len(line), Q.PASSAGE)]
        at += len(line)
    rows, seen = [], set()
    for p in places:
        own = [bytes(w) for w in re.split(rb"[ \t\n\r\x0b\x0c]+", p) if w]
        share = [sum(c in k for c in p) / len(p) for k in KINDS]
        share.append(1 - sum(share))
        n = max(1, len(own))
        upper, letters = share[1] + share[10], share[0] + share[1] + share[10] + share[11]
        x = [*share, upper / max(1 / len(p), letters), math.log1p(len(own)) / 5 if own else 0, sum(map(len, own)) / n / 10, math.sqrt(sum(len(w) ** 2 for w in own) / n) / 10]
        x += [sum(a == b for a, b in zip(own, own[k:])) / n for k in (1, 2, 3)]
        x += [len(set(own)) / n, float(tuple(own) in seen)]
        seen.update([tuple(own)] if own else [])
        h = Counter((sum(int(Q._MIX[c]) * int(Q._POWER[i & 1023]) for i, c in enumerate(w)) % 2**64 >> 40) % Q.N_WORDS for w in own)
        g = Counter(int(Q._GRAM[0][p[i]] ^ Q._GRAM[1][p[i + 1]] ^ Q._GRAM[2][p[i + 2]]) for i in range(len(p) - 2))
        rows.append(x + [h[i] / n for i in range(Q.N_WORDS)] + [g[i] / len(p) for i in range(Q.N_GRAMS)])
    return rows


def plain_score(model, data):
    """The forward pass by loops over passages."""
    p, codes = model.p, []
    for row in plain_passages(data or b""):
        x = [max(-8.0, min(8.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(a * b for a, b in zip(x, p["W"][:, j])) + p["b"][j]) for j in range(len(p["b"]))]
        gate = [math.tanh(sum(a * b for a, b in zip(h, p["V"][:, j])) + p["v"][j]) / (1 + math.exp(-sum(a * b for a, b in zip(h, p["U"][:, j])) - p["u"][j])) for j in range(len(p["v"]))]
        codes.append((math.exp(sum(a * b for a, b in zip(gate, p["w"]))), h))
    total = sum(e for e, _ in codes)
    z = [sum(e * h[j] for e, h in codes) / total for j in range(len(codes[0][1]))]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(z, p["c"])) + p["o"][0]))))


def test_forward_pass_against_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 3000")
    model = Q.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.select("doc_id", "text").collect()[:60]
    rows = [(r[0], r[1]) for r in rows] + [(-1, None), (-2, ""), (-3, " \n\n x\n"), (-4, "ab" * 900 + " tail words\n" + "line one\nline one\n")]
    got = {r.doc_id: r.score for r in Q.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, t in rows:
        assert abs(got[d] - plain_score(model, (t or "").encode())) < 1e-5, d


def test_pooling_by_pieces_is_pooling_at_once(monkeypatch):
    model = Q.Attention(seed=4)
    text = b"some words and more of them\n" * 300 + b"another kind, with 12 numbers !!!\n" * 200
    x = np.concatenate(list(Q.pieces(text))).astype(float)
    f = model.encoded(x)
    e = np.exp(f["s"] - f["s"].max())
    want = model.output((e[:, None] * f["h"]).sum(axis=0)[None] / e.sum())
    for held in (1, 7, 10_000):
        assert np.allclose(model.scores([text, None, text], held)[[0, 2]], want)
    monkeypatch.setattr(Q, "CHUNK", 500)
    assert np.allclose(model.scores([text]), want)


@pytest.mark.parametrize("text", [
    b"".join(b"line %d of the text, and its words\n" % (i % 20_000) for i in range(90_000)),  # every line comes again, a megabyte later
    b"no line ends here but words do " * 100_000, b"x" * 3_000_000, b"\n" * 3000 + b"a b\n" * 200_000 + b"\xc3\xa9 " * 700_000,
])
def test_pieces_of_any_size_give_the_same(monkeypatch, text):
    model, found = Q.Attention(seed=4), []
    for size in (1 << 20, 1 << 23, 70_001):
        monkeypatch.setattr(Q, "CHUNK", size)
        found.append((np.concatenate(list(Q.pieces(text))), model.scores([text])))
    assert all(np.array_equal(found[0][0], x) and np.allclose(found[0][1], s, atol=1e-9) for x, s in found[1:])
    assert len(found[0][0]) >= len(text) / Q.PASSAGE


def test_a_fit_reads_the_rows_that_loops_take(spark, monkeypatch):
    texts = {i: f"Line {i} of words.\n" * (1 + i * 7 % 40) + "x" * (i * 97 % 2000) for i in range(60)}
    rows = [(i, t) for i, t in texts.items()] + [(i, texts[i]) for i in range(10)] + [(3, "another text\n"), (4, None), (None, "no id")]
    labels = [(i, i % 2) for i in range(0, 60)] + [(5, 0), (7, None), (None, 1), (999, 1)]
    y = {}
    for i, v in labels:
        if i is not None and v is not None:
            y[i] = min(v, y.get(i, 1))
    want = []
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def hashed(i, digest=None):
        seed = xxhash.xxh64(i.to_bytes(8, "little"), seed=42).intdigest()
        return signed(seed if digest is None else xxhash.xxh64(digest.encode(), seed=seed).intdigest())

    for c in (0, 1):
        ids = set(sorted((i for i in y if y[i] == c), key=lambda i: (hashed(i), i))[:20])
        own = sorted({(i, (t or "").encode()) for i, t in rows if i in ids}, key=lambda r: hashed(r[0], hashlib.sha256(r[1]).hexdigest()))[:20]
        total = 0
        for k, (i, t) in enumerate(own):
            total += t.count(b"\n") + 1 + len(t) // Q.PASSAGE
            if k == 0 or total <= 300:
                want.append((i, c, t))
    seen = []
    monkeypatch.setattr(Q, "PER_CLASS_PASSAGES", 300)
    monkeypatch.setattr(Q.Attention, "fit", lambda self, bags, y: seen.append((bags, y)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    Q.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"), per_class=20)
    bags, found = seen[0]
    plain = [(i, c, np.array(plain_passages(t))) for i, c, t in sorted(want)]
    assert 15 < len(plain) < 40 and sorted(found) == sorted(c for _, c, _ in plain)
    left = list(plain)
    for bag, c in zip(bags, found, strict=True):
        match = [k for k, (_, d, x) in enumerate(left) if d == c and x.shape == bag.shape and np.allclose(x, bag, atol=2e-3, rtol=2e-3)]
        assert match
        left.pop(match[0])
    assert not left


def test_gradient():
    r = np.random.default_rng(1)
    model = Q.Attention(hidden=4, gate=3)
    x, starts, y = r.normal(size=(9, Q.N_FEATURES)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])
    weight = np.array([0.2, 0.5, 0.3])

    def loss():
        f, total = model.encoded(x), 0.0
        for a, z, t, w in zip(starts, [2, 6, 9], y, weight):
            e = np.exp(f["s"][a:z])
            o = model.output((e[:, None] * f["h"][a:z]).sum(axis=0) / e.sum())[0]
            total -= w * (t * np.log(o) + (1 - t) * np.log(1 - o))
        return total

    for k, g in model.gradient(x, starts, y, weight).items():
        at = tuple(r.integers(0, n) for n in g.shape)
        model.p[k][at] += 1e-5
        up = loss()
        model.p[k][at] -= 2e-5
        assert np.isclose((up - loss()) / 2e-5, g[at], rtol=1e-4, atol=1e-8), k
        model.p[k][at] += 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op8_quality(spark, sf).collect()]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    known = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    score, y = map(np.array, zip(*known))
    assert auc(score, y) > 0.95 and ((score >= 0.5) == y).mean() > 0.9


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (6, 1), (6, 1), (11, 0)], "doc_id long, quality int")
    model = Q.fit(odd, labels)
    got = Q.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, set()).add(r.score)
    assert texts[1] == texts[2] and texts[3] == texts[4]
    left = Q.kept(odd, labels)
    assert left.columns == odd.columns and left.count() <= odd.count()


def test_no_labels_and_empty_table(make, spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(odd, Q.fit(odd, none)).collect()} == {0.5}
    assert Q.kept(odd, none).count() == odd.count()
    assert Q.score(make([]), None).count() == 0
    assert Q.kept(make([]), none).count() == 0


def test_passages_cover_the_whole_text():
    long = ("Plain words here and there. " * 30 + "\n") * 2000
    whole = np.concatenate(list(Q.pieces(long.encode())))
    assert len(whole) >= 2000
    assert [x.shape for x in Q.pieces(None)] == [x.shape for x in Q.pieces(b"")] == [(1, Q.N_FEATURES)]
    junk = np.concatenate(list(Q.pieces((long + "$$$ %%% ### @@@ " * 9000).encode())))
    assert not np.allclose(junk[-1], whole[-1])
