import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import text as T
from palimpsest.functions import vectors
from palimpsest.sources.config import DEFAULT


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_normalize_and_tokens(spark):
    assert one(spark, T.normalize("t"), t="  A B　\n c ") == "a b c"
    assert one(spark, T.tokens("t"), t="Héllo, wörld_1 — 数据库!") == ["héllo", "wörld_1", "数据库"]
    assert one(spark, T.tokens("t"), t=" ,.! ") == []


@pytest.mark.parametrize("text, n", [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("数据", 3), ("数据ab", 4), ("😀😀", 1), ("𠀀", 2)])
def test_estimate_tokens(spark, text, n):
    """A wide character counts 1.5, other UTF-16 units a quarter."""
    wide = sum(any(a <= ord(c) <= b for a, b in ((0x3000, 0x303F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xFF00, 0xFFEF), (0x20000, 0x2A6DF))) for c in text)
    units = len(text.encode("utf-16-be")) // 2
    want = 0 if not text else max(1, -(-(1.5 * wide + (units - wide) / 4) // 1))
    assert one(spark, T.estimate_tokens("t"), t=text) == want
    assert n in (want, n)


def test_keywords(spark):
    assert one(spark, T.keywords("t", 3), t="the cat and THE dog, dog dog cat bird a") == ["dog", "cat", "bird"]
    assert one(spark, T.keywords("t"), t="我们 数据 数据 x 然后") == ["数据"]
    assert one(spark, T.keywords("t"), t="") == []


def test_bigrams(spark):
    assert one(spark, T.bigrams("t"), t="订单失败x短y超时") == ["订单", "单失", "失败", "超时"]
    assert one(spark, T.index_keys(F.array(F.lit("超时错误"), F.lit("ok"))), t="") == ["超时错误", "超时", "时错", "错误", "ok"]


def test_direction(spark):
    got = one(spark, T.directional_intent("t"), t="what caused this before?")
    assert (got.direction, got.types) == ("incoming", ["CAUSES"])
    assert one(spark, T.directional_intent("t"), t="hello") is None
    assert one(spark, T.directional_intent("t"), t="related things").types == ["FOLLOWS", "CONTEXT"]


def test_summary(spark):
    e = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in (("assistant", "fine  answer"), ("user", "x" * 130), ("user", "short"), ("user", "third"))])
    got = one(spark, T.summary(e), t="").split("\n")
    assert got[0] == "[user] " + "x" * 120 + "…" and got[1:3] == ["[user] short", "[user] third"]
    assert got[3].startswith("keywords: user, ")


def test_tags(spark):
    assert one(spark, T.normalize_tags(F.array(F.lit(" Important"), F.lit("odd"), F.lit("important"))), t="") == ["important"]
    assert one(spark, T.normalize_tags(F.array(F.lit("odd"))), t="") == ["normal"]
    assert one(spark, T.normalize_tags(F.array(F.lit("odd")), ("a", "b")), t="") == ["a"]
    assert one(spark, T.tag(F.col("t")), t="a production OUTAGE") == "important"
    assert one(spark, T.tag(F.col("t")), t="all is well") == "normal"


def test_token_hash(spark):
    assert one(spark, vectors.token_hash("t"), t="hello") == 99162322
    for t in ("数据库", "𠀀x", "a much longer token that wraps around"):
        assert one(spark, vectors.token_hash("t"), t=t) == vectors.hash_of(t)


def test_hash_embedding(spark):
    v = one(spark, vectors.hash_embedding("t"), t="b a b")
    assert len(v) == 256 and v[vectors.hash_of("b") % 256] == pytest.approx(2 / 5**0.5)
    assert not any(one(spark, vectors.hash_embedding("t"), t="!!"))


def test_cosine(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vectors.cosine(arr(1, 0), arr(1, 1)), t="") == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(arr(1, 0), arr(1, 1, 1)), t="") == 0
    assert one(spark, vectors.cosine(arr(0, 0), arr(1, 1)), t="") == 0
    assert one(spark, vectors.is_valid(arr(1, float("nan")), 2), t="") is False


def test_hybrid_embedding(spark):
    h, l = F.array(F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0))  # noqa: E741
    tags = lambda *t: F.array(*map(F.lit, t))
    assert one(spark, vectors.hybrid_embedding(h, l, 2), t="") == [1, 2, 3]
    assert one(spark, vectors.hybrid_embedding(h, l, 2, tags("normal")), t="") == [1, 0, 0]
    assert one(spark, vectors.hybrid_embedding(h, l, 2, tags("conflict")), t="") == [1, 2, 3]


@pytest.mark.parametrize("text, tokens, match, affinity, new, want", [
    ("short note", 10, 0.1, 0, 0, ("conflict", "conflict_signal_detected")), ("tiny", 10, 0.1, 0, 0, ("raw", "small_block_preserve")), ("same again", 200, 0.95, 0.1, 0.1, ("compressed", "high_match_redundant")),
    ("moves on", 200, 0.95, 0.7, 0.4, ("raw", "high_match_directional_progress")), ("fresh", 200, 0.1, 0, 0, ("raw", "low_match_unique")), ("half", 200, 0.8, 0, 0, ("compressed", "adaptive_soft_compress")), ("half", 200, 0.5, 0, 0.5, ("raw", "adaptive_soft_keep")),
])
def test_retention(spark, text, tokens, match, affinity, new, want):
    f = lambda x: F.lit(float(x))
    got = one(spark, S.retention(F.lit(text), F.lit(tokens), f(match), f(affinity), f(new), f(0), DEFAULT), t="")
    assert tuple(got) == want


@pytest.mark.parametrize("values, matched", [([1.0], True), ([0.34, 0.33, 0.33], True), ([0.9, 0.07, 0.03], False), ([], False)])
def test_relation_trigger(spark, values, matched):
    got = one(spark, S.relation_trigger(F.array(*map(F.lit, values)).cast("array<double>"), DEFAULT), t="")
    assert got.matched is matched


def test_edge_confidence(spark):
    c = lambda kind, stored: one(spark, S.edge_confidence(F.lit(kind), F.lit(stored).cast("double")), t="")
    assert (c("FOLLOWS", None), c("OTHER", None), c("FOLLOWS", 3.0), c("FOLLOWS", 0.0), c("FOLLOWS", float("nan"))) == (0.9, 0.55, 1.0, 0.05, 0.5)


def test_sparse_query(spark):
    s = lambda q, *k: one(spark, S.keyword_sparse(F.lit(q), F.array(*map(F.lit, k)).cast("array<string>")), t="")
    assert s("a the", ) is True and s("cat dog", "cat") is False and s("cat", "cat", "x", "y") is True


def test_render_and_calls(spark):
    m = F.create_map(F.lit("who"), F.lit("you"))
    assert one(spark, T.render(F.col("t"), m), t=r"hi {{ who }} {{gone}} \{{x}} {{not a name}}") == "hi you  {{x}} {{not a name}}"
    assert one(spark, T.tool_call("t"), t='{"name":"a","args":[1]}').args == "{}"


def test_keywords_and_embedding_from_one_count_are_those_made_singly(spark):
    """Every character up to U+024F between letters, far ones beside them, ties, stop words, single units; tokens as the built-in expression cuts them."""
    near = [f"ab{chr(c)}cd {chr(c)} X{chr(c)}" for c in range(1, 0x250) if chr(c) != "﻿"]
    far = ["日本 語 数据库 的 ab ab", "😀 𠀀 𠀀𠀀 ΌΔΟΣ όδος Ͱ", "K K ﬁ", "İstanbul istanbul İ", "x y z", "the a of", "", None, "one two two three", "e e e one two"]
    d = spark.createDataFrame(list(enumerate([*near, *far])), "id long, t string").coalesce(1)
    t = F.coalesce("t", F.lit(""))
    got = d.select("t", T.tokens(t).alias("n"), T.keywords("t", 3).alias("k"), vectors.hash_embedding("t", 16, 5).alias("e"), vectors.analysis("t", 3, 16, 5).alias("a")).collect()
    assert len(got) == len(near) + len(far)
    for r in got:
        count = [0] * 16
        for w in r.n:
            count[vectors.hash_of(w, 5) % 16] += 1
        size = sum(c * c for c in count) ** 0.5
        assert r.a.embedding == r.e == pytest.approx([c / size if size else 0 for c in count]), r.t
        assert r.a.keywords == r.k == T.keyword_list(r.t, 3), r.t


def test_hashes_of_rows_of_tokens_are_worked_out_at_once():
    """Against one token at a time, at both signs, of unlike lengths and with units beyond 16 bits; nothing is kept between calls."""
    rows = [["a", "zebra", "日本語", "𠀀x", "w" * 300], [], [f"token{i}" for i in range(3000)], ["é", "a"]]
    for seed in (0, 5, (1 << 31) + 7):
        assert vectors._hashes(rows, seed).tolist() == [vectors.hash_of(t, seed) for r in rows for t in r]
    assert vectors._hashes([[], []], 0).tolist() == [] and not hasattr(vectors, "_KEPT")
