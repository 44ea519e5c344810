import math
import re

import numpy as np

from palimpsest.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def brute(chain, text, nudge=None):
    """The chain's probabilities by plain loops; nudge: category -> what is added to its probability for later links."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    seen = {}
    for w in words:
        for t in [w] + [w[:n] + "*" for n in (4, 5, 6, 7, 8) if len(w) > n]:
            if t in chain.index:
                seen[t] = seen.get(t, 0) + 1
    n, letters, chars = len(words), sum(map(len, words)), len(text or "")
    out, passed = [], []
    for name, link in zip(chain.names, chain.links, strict=True):
        mine = {t: c for t, c in seen.items() if link.known[chain.index[t]]}
        total = sum(mine.values())
        x = [1, bool(mine), math.log1p(len(mine)), math.log1p(total), math.log1p(1000 * total / max(1, n)), 1 - letters / chars if chars else 0, letters / max(1, n) / 10, len(set(words)) / max(1, n), *passed]
        z = sum(link.w[chain.index[t]] for t in mine) + sum(a * b for a, b in zip(x, link.v, strict=True))
        out.append(1 / (1 + math.exp(-min(30, max(-30, z)))))
        passed.append(out[-1] + (nudge or {}).get(name, 0))
    return out


def test_held_out_accuracy_and_plain_forward_pass(spark):
    from palimpsest.llm.quality import held_out

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.fit(docs, labels.filter(~held_out()))
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF).collect()}
    assert len(got) == docs.count()
    known = labels.filter(held_out()).collect()
    y, p = np.array([r.toxic for r in known]), np.array([got[r.doc_id].toxic for r in known])
    assert (p[y == 0] == 0).mean() >= 0.98 and (p[y == 1] == 1).mean() >= 0.8
    changed = 0
    for r in docs.select("doc_id", "text").collect():
        want, g = brute(chain, r.text), got[r.doc_id]
        assert np.allclose(want, [g.p_prose, g.p_junk, g.p_toxic], atol=1e-9) and g.toxic == (g.p_toxic >= 0.5)
        changed += (brute(chain, r.text, {"prose": 0.9 if want[0] < 0.5 else -0.9})[-1] >= 0.5) != (want[-1] >= 0.5)
    assert changed > 0  # an earlier category's probability decides with


def bags(x):
    return toxicity.Bags([({i: 1 for i, v in enumerate(r) if v}, [1, 1, 1, 1]) for r in x])


def test_later_links_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3)) < 0.5
    a = x[:, 0].astype(float)
    b = a * x[:, 1]
    every = {f: np.ones(3, bool) for f in range(-1, 5)}
    chain = toxicity.Chain(["a", "b"], ["u", "v", "w"]).fit(bags(x), np.column_stack([a, b]), np.arange(400) % 5, every)
    assert [len(m.v) for m in chain.links] == [8, 9]
    assert ((chain.predict(bags(x)) >= 0.5) == np.column_stack([a, b])).mean() > 0.9
    assert chain.links[1].v[8] > 0


def test_terms_are_chosen_without_the_fold(spark):
    """A word that only one fold's toxic rows have is not among the terms chosen without that fold."""
    rows = [(f"plain words{'' if i % 2 else ' vile'}{' onlyhere' if not i % 2 and toxicity.hash_fold(i) == 2 else ''}", 1 - i % 2, i) for i in range(200)]
    chosen = toxicity.choose(spark.createDataFrame(rows, "_text string, _y int, _id long"))
    assert sorted(chosen) == [-1, 0, 1, 2, 3, 4] and all("vile" in c for c in chosen.values())
    assert [f for f, c in sorted(chosen.items()) if "onlyhere" not in c] == [2]


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, None), (3, None, 0), (6, 0, 0), (6, 1, 0), (None, 1, 1)], "doc_id long, toxic int, quality int")
    chain = toxicity.fit(odd, labels)
    got = toxicity.score(odd, chain).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.p_toxic)
    assert by[3] == by[4] and len(by[2]) == 1
    assert toxicity.score(odd, toxicity.fit(odd, labels.drop("quality"))).columns == ["doc_id", "p_toxic", "toxic"]


def test_no_labels_and_empty_table(make, spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxic for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()} == {0}
    assert toxicity.score(make([]), None).count() == 0
    assert toxicity.fit(make([]), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")) is None


def test_words_of_long_texts():
    text = "alpha " * 400_000 + "Zeta"
    got = [w for some in toxicity.words(text) for w in some]
    assert len(got) == 400_001 and got[-1] == "zeta"


def test_pieces_of_any_size_give_the_same(monkeypatch):
    text = "".join(f"word{chr(97 + i % 26)} of line {'abcdefgh'[i % 8] * 6} goes on\n" for i in range(90_000)) + "vile tail"
    index, found = toxicity.Index(["vile", "line*", "word*", "goes"]), []
    for size in (1 << 20, 1 << 23, 70_001):
        monkeypatch.setattr(toxicity, "_PIECE", size)
        found.append(index.features(text))
    words = re.findall(r"[^\W\d_]+", text.lower())
    assert found[0] == found[1] == found[2] and found[0][1] == [len(words), sum(map(len, words)), len(text), len(set(words))]
    assert found[0][0][index["vile"]] == 1 and found[0][0][index["goes"]] == 90_000


def test_chosen_terms_against_loops(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["plain", "words", "here", "vileness", "vilely", "nasty", "nastier", "common"]
    rows = []
    for i in range(240):
        y = int(i % 3 == 0)
        own = [w for w in vocabulary[:3] + vocabulary[7:] if rng.random() < 0.5] + [w for w in vocabulary[3:7] if rng.random() < (0.4 if y else 0.02)]
        rows.append((" ".join(own), y, i))
    got = toxicity.choose(spark.createDataFrame(rows, "_text string, _y int, _id long").repartition(3), n_terms=6)
    for without in range(-1, toxicity.FOLDS):
        own = [(t, y) for t, y, i in rows if toxicity.hash_fold(i) != without]
        n = {}
        for t, y in own:
            for term in {x for w in t.split() for x in [w] + [w[:k] + "*" for k in (4, 5, 6, 7, 8) if len(w) > k]}:
                n.setdefault(term, [0, 0])[y] += 1
        size = [sum(y == c for _, y in own) for c in (0, 1)]
        odds = {t: math.log((a + 0.5) / (size[1] + 1)) - math.log((b + 0.5) / (size[0] + 1)) for t, (b, a) in n.items() if a >= 3}
        want = sorted((t for t in odds if odds[t] > 2), key=lambda t: (-odds[t] * math.sqrt(n[t][1]), t))[:6]
        assert got[without] == want and want


def test_a_fit_reads_bounded_rows(spark, monkeypatch):
    rows = [(1, "vile words")] * 500 + [(1, f"another text {i}") for i in range(50)] + [(i, f"plain words {i}") for i in range(2, 60)]
    seen = []
    monkeypatch.setattr(toxicity, "choose", lambda sample: seen.append(sample.collect()) or {f: ["vile"] for f in range(-1, toxicity.FOLDS)})
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 60)], "doc_id long, toxic int"), per_class=20)
    toxic = [r._text for r in seen[0] if r._y == 1]
    assert len(toxic) == len(set(toxic)) == 20 and sum(r._y == 0 for r in seen[0]) == 20
