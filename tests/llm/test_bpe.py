import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from palimpsest.llm import bpe

V = bpe.vocabulary(bpe.default_path(), P.PATTERN)


@pytest.fixture(scope="module")
def ours():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=V.ranks, special_tokens={})


def brute(ours, text):
    ids = ours.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_odd_rows(odd, ours):
    rows = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in bpe.round_trip(odd).collect():
        assert tuple(r)[1:] == brute(ours, rows[r.doc_id] if r.doc_id is not None else {4: "a b c d"}.get(r.n_tokens))


def test_whole_table(spark, sf, ours):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.round_trip(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute(ours, rows[r.doc_id])


def test_arrays_and_back(make):
    docs = make([(1, "Hé, wörld  \n 123"), (2, ""), (3, None), (4, "日本語のテキスト😀")])
    got = {r.doc_id: bytes(r.data).decode() for r in bpe.decoded(bpe.encoded(docs)).collect()}
    assert got == {1: "Hé, wörld  \n 123", 2: "", 3: "", 4: "日本語のテキスト😀"}


@pytest.mark.parametrize("seed", range(40))
def test_random_pieces(ours, seed):
    r = random.Random(seed)
    alphabet = r.choice(["ab", "etaoinshr ", "é à ü ñ ç", " \n\t", "0123456789", "日本語中文字", "😀👍🏽", "".join(map(chr, range(32, 400)))])
    text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 300)))
    assert V.encode(text) == ours.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(20))
def test_append_and_edit(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("etaoinshrdlu") for _ in range(n)).encode()
    data = word(60)
    t = bpe.PrefixTable(V, data)
    more = word(20)
    t.append(more)
    assert t.tokens() == V.merge(data + more)
    a = r.randint(0, 40)
    new = word(r.randint(0, 9))
    t.edit(a, a + 7, new)
    data = (data + more)[:a] + new + (data + more)[a + 7 :]
    assert t.data == data and t.tokens() == V.merge(data)


def test_memo_restarts(ours, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    v = bpe.Vocabulary(bpe.default_path(), P.PATTERN)
    text = "one two three four five six seven eight nine ten eleven"
    assert b"".join(bpe._blobs(v, text)) == np.array(ours.encode_ordinary(text), "<u4").tobytes()
    monkeypatch.setattr(bpe, "LONG", 10)
    assert b"".join(bpe._blobs(v, text)) == np.array(ours.encode_ordinary(text), "<u4").tobytes()


def test_repeated_rows_and_empty_table(make, ours):
    got = bpe.round_trip(make([(1, "same words"), (1, "same words"), (2, None), (None, "x" * 300_000)])).collect()
    empty = [r for r in got if r.doc_id == 2][0]
    assert len(got) == 4 and got[0] == got[1] and empty.n_tokens == 0 and empty.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.n_tokens for r in got if r.doc_id is None] == [len(ours.encode_ordinary("x" * 300_000))]
    none = bpe.round_trip(make([]))
    assert none.collect() == [] and none.columns == got[0].__fields__


def test_pairs_are_judged_without_merging_them(monkeypatch):
    """As merging from scratch does it, on pairs of neighbours in text and at random; texts are encoded without merges of pairs."""
    r = random.Random(5)
    some = [t for t in V.ranks.values() if V.stands(t)]
    pairs = [(r.choice(some), r.choice(some)) for _ in range(3000)]
    for _ in range(6000):  # two parts of a token, so that many pairs are not valid
        data = V.bytes_of[r.choice(some)] + V.bytes_of[r.choice(some)]
        at = r.randint(1, len(data) - 1)
        if (a := V.ranks.get(data[:at])) is not None and (b := V.ranks.get(data[at:])) is not None:
            pairs.append((a, b))
    want = [V.merge(V.bytes_of[a] + V.bytes_of[b]) == [a, b] for a, b in pairs]
    assert [V._valid(a, b) for a, b in pairs] == want and 20 < sum(want) < len(want) - 20
    # Ranks that fall: a vocabulary whose long token comes before its parts.
    odd = bpe.Vocabulary(bpe.default_path(), P.PATTERN)
    odd.ranks = {b"abc": 0, b"a": 1, b"b": 2, b"c": 3, b"ab": 4, b"bc": 5, b"ca": 6, b"cab": 7}
    odd.bytes_of, odd.parts = {v: k for k, v in odd.ranks.items()}, {}
    for a in odd.bytes_of:
        for b in odd.bytes_of:
            assert odd._valid(a, b) == (odd.merge(odd.bytes_of[a] + odd.bytes_of[b]) == [a, b])
    v = bpe.Vocabulary(bpe.default_path(), P.PATTERN)
    monkeypatch.setattr(v, "merge", lambda data: [v.ranks[data]])
    assert v.encode("xqzvbnm wrtlkjh plonterisk") == V.encode("xqzvbnm wrtlkjh plonterisk")
