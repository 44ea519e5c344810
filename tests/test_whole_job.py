"""Queries answer for the whole table, not for its first ids or the beginnings of its texts."""

import re
from collections import Counter

import pytest

from palimpsest import catalog
from palimpsest.functions import words
from palimpsest.operators import detect, retrieve
from palimpsest.plans import base
from palimpsest.sources.config import DEFAULT


@pytest.mark.parametrize("name", ["embedding_topk", "two_stage_topk", "lsh_topk"])
def test_every_twentieth_vector_is_asked(spark, sf, name):
    want = {r.vec_id for r in base.table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select("vec_id").collect()}
    assert max(want) >= 20
    assert {r.query_id for r in catalog.queries()[name](spark, sf).select("query_id").collect()} == want


@pytest.mark.parametrize("name", ["graph_traverse", "graph_topk", "random_walk", "predicted_intents"])
def test_every_customer_is_a_seed(spark, sf, name):
    table = lambda t, key: {r[0] for r in base.table(spark, sf, t).select(key).collect()}
    # Without an order there is nowhere to go; the traversal still has the seed itself.
    want = table("customer", "c_custkey") if name == "graph_traverse" else table("customer", "c_custkey") & table("orders", "o_custkey")
    assert max(want) > 40
    assert {r.query_id for r in catalog.queries()[name](spark, sf).select("query_id").collect()} == want


def test_recall_of_lsh_topk(spark, sf):
    found = lambda name: {(r.query_id, r.vec_id) for r in catalog.queries()[name](spark, sf).collect()}
    exact = found("embedding_topk")
    assert len(exact & found("lsh_topk")) / len(exact) >= 0.9


def _tokens(text):
    return re.findall(r"\w+", text.lower())


def _keywords(text):
    count = Counter(t for t in _tokens(text) if len(t) > 1 and t not in words.STOP_EN)
    return [t for t, _ in count.most_common(8)]  # ties stay in the order of the text


@pytest.fixture(scope="module")
def long_turns(spark, tmp_path_factory):
    """Conversations of a turn; the first one asks behind its 200th character for what the last one says."""
    asked = "please " * 40 + " ".join(["zebra quartz harbour lantern"] * 45)
    texts = [asked, *[" ".join(f"w{i}x{j} w{i}x{j}" for j in range(8)) for i in range(1, 12)], "zebra quartz harbour lantern"]
    at = tmp_path_factory.mktemp("long")
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at), texts


def test_engine_context_reads_whole_questions(spark, long_turns):
    at, texts = long_turns
    jaccard = {i: len(a & b) / len(a | b) for a in [set(_keywords(texts[0]))] for i, t in enumerate(texts) if (b := set(_keywords(t)))}
    want = sorted((i for i in jaccard if jaccard[i] > 0), key=lambda i: (-jaccard[i], i))
    assert want == [0, len(texts) - 1]
    formatted = next(r.formatted for r in catalog.queries()["engine_context"](spark, at).collect() if r.query_id == 0)
    assert [int(x) for x in re.findall(r"#\d+ \[block_(\d+)_", formatted)][:2] == want


def test_engine_signals_reads_whole_questions(spark, long_turns, monkeypatch):
    at, texts = long_turns
    monkeypatch.setattr(detect, "detect", lambda log, cfg: log)
    got = {r.seq: (r.n_tokens, list(r.keywords)) for r in catalog.queries()["engine_signals"](spark, at).collect()}
    assert got == {i: (len(_tokens(t)), _keywords(t)) for i, t in enumerate(texts)}


def test_overlap_of_whole_turns(spark, tmp_path):
    only = lambda w: f"{w} " * 40 + "zebra quartz harbour" + f" {w}" * 40  # what both turns share lies in the middle
    rows = [(1, 0, only("one")), (1, 1, only("two")), (2, 0, "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in catalog.queries()["set_overlap"](spark, str(tmp_path)).collect()] == [(1, 1, 3, 0.6, True)]


def test_truth_of_retrieval_metrics_has_no_row_cap(spark, sf, monkeypatch):
    want = catalog.queries()["retrieval_metrics"](spark, sf).collect()
    top = retrieve.keyword_topk
    monkeypatch.setattr(retrieve, "keyword_topk", lambda q, b, k: top(q, b, min(k, DEFAULT.semantic_top_k)))  # a cap that small tables reach
    assert catalog.queries()["retrieval_metrics"](spark, sf).collect() == want


def test_get_many_fetches_every_conversation(spark, tmp_path):
    rows = [(i, j) for i in range(25) for j in range(i % 3 + 1)]
    spark.createDataFrame([(*r, "user", "text") for r in rows], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = [r for r in reversed(rows) if r[0] % 10 == 0] + rows
    assert [r.block_id for r in catalog.queries()["get_many"](spark, str(tmp_path)).collect()] == [f"block_{i:010d}_{j:06d}" for i, j in want]
