import math
import re
from collections import Counter

import pytest

from palimpsest.llm import ngram_lm, queries


def brute(rows, order=2, without_own=True):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in rows]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in docs]
    total = sum(grams, Counter())
    words = sum(map(len, docs))
    out = []
    for (d, _), w, own in zip(rows, docs, grams):
        c = (lambda g, own=own: total[g] - own[g]) if without_own else (lambda g: total[g])
        every = max(1, words - len(w) * without_own)
        score = 0.0
        for i in range(len(w)):
            best = None
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                given = min(order, i + 1) - n
                if n == 1:
                    best = max(c(g), 0.5) / every
                elif c(g) > 0 and c(g[:-1]) > 0:
                    best = c(g) / c(g[:-1])
                if best is not None:
                    score += math.log(best * 0.4**given)
                    break
        out.append((d, len(w), score))
    return sorted(out, key=str)


def check(df, **how):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows, how.get("order", 3), how.get("without_own", True))
    got = sorted(((r[0], r[1], r[2], r[3]) for r in ngram_lm.scores(df, **how).collect()), key=str)
    key = lambda x: (str(x[0]), x[1], round(x[2], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9, abs=1e-9)
        assert g[3] is None if g[1] == 0 else g[3] == pytest.approx(g[2] / g[1])


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("without_own", [True, False])
def test_small_blocks(spark, sf, order, without_own):
    check(spark.read.parquet(f"{sf}/documents.parquet"), order=order, without_own=without_own, block_bytes=60_000, part=5000)


def test_odd_rows(odd):
    check(odd)
    check(odd, block_bytes=1000, part=10, order=3)


def test_query_and_empty_table(spark, sf, make):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert queries.op7_ngram_lm(spark, sf).count() == docs.count()
    assert ngram_lm.scores(make([])).count() == 0
    check(make([(1, "only one"), (2, None)]))
