"""Tokens of many texts at once, against one text at a time."""

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.functions import text as T
from palimpsest.functions import tokens, vectors

ODD = ["", "a", "one", "an c0 an c0", "the a of", "x_1 X_1 x1", "  Two two\tTWO\n", "Straße ÉTÉ été İstanbul Ͱ ΌΔΟΣ", "日本 語 语 语语 语语", "é" * 300 + " é", "once more 12 12 3", "end_"]


def expected(text, dim, seed, n):
    c = T.near_counts(text)
    bins = [0] * dim
    for t, times in c.items():
        bins[vectors.hash_of(t, seed) % dim] += times
    return bins, T.most_frequent(c, n)


@pytest.mark.parametrize("units", [tokens.UNITS, 1000])
def test_texts_cut_at_once(monkeypatch, units):
    monkeypatch.setattr(tokens, "UNITS", units)
    tokens._tables.cache_clear()
    rng = np.random.default_rng(1)
    texts = [*ODD, *[" ".join(f"W{j}é{j % 3}" if j % 2 else f"w{j}" for j in rng.integers(0, 9, rng.integers(1, 40))) for _ in range(200)]]
    assert all(map(tokens.fits, texts)) and not tokens.fits("😀 x") and not tokens.fits("x" * units)
    runs = list(tokens.runs(texts))
    assert [i for lo, hi in runs for i in range(lo, hi)] == list(range(len(texts))) and (len(runs) > 1) == (units == 1000)
    for seed in (0, (1 << 31) + 7):
        for lo, hi in runs:
            cut = tokens.Tokens(texts[lo:hi])
            want = [expected(t, 16, seed, 3) for t in texts[lo:hi]]
            assert cut.bins(16, seed).tolist() == [w[0] for w in want] and cut.keywords(3) == [w[1] for w in want]
    tokens._tables.cache_clear()


def test_plain_texts_are_not_counted_one_by_one(monkeypatch):
    """boosted_ranks and what else embeds documents: only a text with a pair of units, or a very long one, is tokens as objects."""
    seen = []
    real = T.near_counts
    monkeypatch.setattr(T, "near_counts", lambda t: seen.append(t) or real(t))
    texts, words = [*ODD, "😀 x y", "w" * (tokens.UNITS + 1)] * 30, []
    got = np.asarray(vectors.embedded(pa.array(texts), 16, 5, None, 3, words).flatten()).reshape(-1, 16)
    assert set(seen) == set(texts[len(ODD) : len(ODD) + 2])
    for t, v, k in zip(texts, got, words, strict=True):
        bins, want = expected(t, 16, 5, 3)
        assert k == want and v == pytest.approx(np.array(bins) / (np.linalg.norm(bins) or 1))
