"""The recurrent network against plain loops and numeric gradients; the fit's choice and the whole query against brute force."""

import math
import zlib

import numpy as np
import pytest
import xxhash

from palimpsest.llm import langid as L
from palimpsest.llm import queries


def plain(net, data):
    """Probabilities of a text, byte by byte, with numbers and loops only."""
    p, k = {n: v.tolist() for n, v in net.p.items()}, net.hidden
    logistic = lambda v: 1 / (1 + math.exp(-v))

    def read(d, piece):
        h, out = [0.0] * k, []
        for byte in piece:
            a = [p["X" + d][i][byte] for i in range(3 * k)]
            g = [sum(p["U" + d][i][j] * h[j] for j in range(k)) for i in range(3 * k)]
            reset = [logistic(a[i] + g[i]) for i in range(k)]
            keep = [logistic(a[k + i] + g[k + i]) for i in range(k)]
            new = [math.tanh(a[2 * k + i] + reset[i] * g[2 * k + i]) for i in range(k)]
            h = [keep[i] * h[i] + (1 - keep[i]) * new[i] for i in range(k)]
            out.append(h)
        return out

    total = [0.0] * len(net.langs)
    for at in range(0, len(data), L.WINDOW):
        piece = data[at : at + L.WINDOW]
        for f, b in zip(read("f", piece), read("b", piece[::-1])[::-1], strict=True):
            z = [sum(p["Of"][c][i] * f[i] + p["Ob"][c][i] * b[i] for i in range(k)) + p["o"][c][0] for c in range(len(net.langs))]
            e = [math.exp(v - max(z)) for v in z]
            total = [t + v / sum(e) for t, v in zip(total, e, strict=True)]
    return [t / max(1, len(data)) for t in total]


def test_probabilities_against_loops():
    net = L.Network(["a", "b", "c"], hidden=3, dtype=np.float64)
    texts = [b"", b"x", bytes(range(256)) * 2 + b"end", "é\U0001f600 ß".encode(), b"y" * L.WINDOW, b"z" * (L.WINDOW + 1)]
    want = np.array([plain(net, t) for t in texts])
    for held in (1, 2, 1000):
        assert np.allclose(net.probabilities(texts, held), want, atol=1e-12)
    assert np.allclose(net.probabilities([texts[2], None]), [want[2], want[0]]) and net.probabilities([]).shape == (0, 3)


def test_gradient_against_differences():
    r = np.random.default_rng(2)
    net = L.Network(["a", "b"], hidden=3, dtype=np.float64)
    sizes, y = np.array([9, 7, 7, 1]), np.array([0, 1, 0, 1])
    x = r.integers(97, 103, (L.WINDOW, 4)).astype(np.uint8)
    _, grad = net.gradient(x, sizes, y)
    for name, g in grad.items():
        places = [tuple(i) for i in np.argwhere(np.abs(g) > 1e-9)]
        assert places
        for at in [places[i] for i in r.integers(0, len(places), 12)]:
            losses = []
            for e in (1e-6, -1e-6):
                net.p[name][at] += e
                losses.append(net.gradient(x, sizes, y)[0])
                net.p[name][at] -= e
            assert math.isclose(g[at], (losses[0] - losses[1]) / 2e-6, rel_tol=1e-4, abs_tol=1e-8), (name, at)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def chosen(rows, per_lang, most):
    """The windows of a fit by plain loops."""
    out, hashed = [], lambda i: signed(xxhash.xxh64(int(i).to_bytes(8, "little", signed=True), seed=42).intdigest())
    for lang in sorted({r[1] for r in rows if r[1] is not None}):
        ids = sorted((hashed(i), i, t) for i, g, t in rows if g == lang and i is not None)
        cut = ids[min(per_lang, len(ids)) - 1][0]
        pieces = {t.encode()[a : a + L.WINDOW] for h, _, t in ids if h <= cut and t and any(c.isalpha() for c in t) for a in range(0, len(t.encode()), L.WINDOW)}
        out += [(lang, x) for x in sorted(pieces, key=lambda x: (signed(xxhash.xxh64(x, seed=42).intdigest()), x))[:most]]
    return sorted(out)


DOCS = "doc_id long, lang string, text string"


def test_fit_takes_the_windows_that_loops_take(spark, monkeypatch):
    rows = [(i, ("en", "de", None, "fr")[i % 4], f"word{i} " * (i % 70)) for i in range(200)] + [(8, "en", "word8 " * 8)] * 5 + [(300, "es", None), (301, "en", "1234 5"), (None, "en", "no id")]
    want, seen = chosen(rows, 20, 40), []
    monkeypatch.setattr(L.Network, "fit", lambda self, x, sizes, y: seen.append((self.langs, [(self.langs[c], bytes(a[:n])) for a, n, c in zip(x, sizes, y, strict=True)])))
    L.fit(spark.createDataFrame(rows, DOCS).repartition(3), per_lang=20, most=40)
    assert seen == [(["de", "en", "fr"], want)] and max(sum(g == x for g, _ in want) for x in ("de", "en", "fr")) == 40


def test_held_out_rows_are_never_learnt_from(spark):
    ids = list(range(60))
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long").select("doc_id", L.held_out().alias("h"))
    assert {r.doc_id: r.h for r in df.collect()} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in ids} | {None: False}


@pytest.fixture(scope="module")
def net(spark):
    words = {"en": "the quick brown fox with other words", "fr": "le renard était très élevé où", "de": "der schnelle fuchs über straße"}
    return L.fit(spark.createDataFrame([(i, g, f"{t} {i}") for i in range(30) for g, t in words.items()], DOCS))


def test_odd_rows(spark, net, odd):
    rows = odd.drop("lang").withColumnRenamed("source", "lang_pred")
    got = L.identify(rows, net)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == rows.count() == 14
    for r in got.collect():
        assert (r.lang_pred == "und" and r.score == 0) or (r.lang_pred in net.langs and 0 < r.score <= 1)
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by_id[2] == by_id[1] * 2 and all(by_id[i] == [("und", 0.0)] for i in (3, 4, 5)) and ("und", 0.0) in by_id[None] and by_id[10][0][0] != "und"
    text = {r[0]: r[1] for r in rows.filter("doc_id in (1, 6, 10, 11)").select("doc_id", "text").collect()}
    for i in (1, 10):
        assert np.isclose(by_id[i][0][1], max(plain(net, text[i].encode())), atol=1e-4)
    one = L.windows(np.frombuffer(text[6].encode(), np.uint8))  # a long text, all windows at once
    whole = net.label(np.ascontiguousarray(one[0].T), one[1]).sum(axis=1) / len(text[6])
    assert np.isclose(by_id[6][0][1], whole.max(), atol=1e-4) and by_id[6][0][0] == net.langs[int(whole.argmax())]


def test_a_text_counts_to_its_end(net):
    start = b"the quick brown fox with other words " * 2000
    a, b = net.probabilities([start, start + "le renard était très élevé où ".encode() * 6000])
    assert net.langs[int(a.argmax())] == "en" and net.langs[int(b.argmax())] == "fr"


def test_without_rows_or_labels(spark, net):
    none = spark.createDataFrame([], DOCS)
    assert L.fit(none) is None and L.identify(none, net).collect() == []
    some = spark.createDataFrame([(1, None, "words"), (2, "en", "12"), (3, "en", None)], DOCS)
    assert L.fit(some) is None and {r.lang_pred for r in L.identify(some, None).collect()} == {"und"}
    assert L.fit(spark.createDataFrame([(1, "en", "words")], DOCS)).langs == ["en"]


def test_query_on_held_out_documents(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op12_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert len(got) == len(docs) and all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    judged = [got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out]
    assert len(judged) > 30 and sum(judged) / len(judged) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    words = {"en": "the quick brown fox", "fr": "le renard était très élevé"}
    rows = [(i, list(words)[i % 2], f"{words[list(words)[i % 2]]} {i}") for i in range(120)]
    other = [(i, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g, t) for i, g, t in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in L.labelled(spark.createDataFrame(x, DOCS)).collect()} for x in (rows, other))
    assert a == b and {v[0] for v in a.values()} == {"en", "fr"}
