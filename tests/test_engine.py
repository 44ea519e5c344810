import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import vectors
from palimpsest.operators import chunks, context, detect, graph, history, relations, retrieve, seal, tiles
from palimpsest.plans.engine import Engine
from palimpsest.sources.config import DEFAULT, load

EV = "session_id bigint, seq bigint, role string, text string, ts_ms bigint"


def sealed(spark, rows, **cfg):
    df = spark.createDataFrame([(1, i, r, t, ts) for i, (r, t, ts) in enumerate(rows)], EV)
    return [r.block_seq for r in seal.assign_blocks(df, load(env={}, **cfg)).orderBy("seq").collect()]


def test_turn_boundary(spark):
    rows = [("user", "question one", 0), ("assistant", "answer one", 1000), ("user", "question two", 2000)]
    assert sealed(spark, rows, min_tokens_per_block=1) == [0, 1, 2]
    assert sealed(spark, rows) == [0, 0, 0]


def test_idle(spark):
    rows = [("user", "a", 0), ("user", "b", 1000), ("user", "c", 70_000)]
    assert sealed(spark, rows, proactive_seal_idle_seconds=60) == [0, 0, 1]
    assert sealed(spark, rows, proactive_seal_idle_seconds=69) == [0, 0, 1]  # a gap at the threshold splits
    assert sealed(spark, rows, proactive_seal_enabled=False) == [0, 0, 0]


def test_limits(spark):
    rows = [("user", "x" * 400, i) for i in range(5)]  # 100 tokens each
    assert sealed(spark, rows, chunk_strategy="fixed") == [0, 0, 0, 1, 1]
    assert sealed(spark, [("user", "x" * 4000, 0), ("user", "y", 1)]) == [0, 1]  # the hard limit seals behind the event
    assert sealed(spark, [("user", "", 0), ("user", "", 1)], max_tokens_per_block=1) == [0, 0]


def test_semantic_boundary(spark):
    long = "x" * 800  # 200 tokens
    cut = lambda a, b, role="user": sealed(spark, [("user", a, 0), (role, b, 1)], chunk_strategy="semantic", proactive_seal_enabled=False)
    assert cut(long, "y" * 600) == [0, 0] and cut(long + ".", "y" * 600) == [0, 1]
    assert cut(long, "Moving on " + "y" * 600) == [0, 1] and cut(long, "y" * 600, "assistant") == [0, 1]
    assert cut(long, "y\n\n" + "y" * 600) == [0, 1] and cut(long + ".", "y" * 40) == [0, 0]
    assert cut(long, "y" * 1000) == [0, 1]  # over 1.35 times the maximum


def test_seal_every(spark):
    df = spark.createDataFrame([(1, i, "user", "a", i) for i in range(5)], EV)
    assert [r.block_seq for r in seal.assign_blocks(df, DEFAULT, seal_every=2).orderBy("seq").collect()] == [0, 0, 1, 1, 2]


def test_late_events_keep_arrival_order(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 100), (1, 1, "user", "b", 50), (1, 2, "user", "c", 50), (1, 3, "user", "d", 500), (1, 4, "user", "e", None)], EV)
    assert [r.ts_ms for r in seal.with_monotone_time(df).orderBy("seq").collect()] == [100, 101, 102, 500, 501]


def test_every_event_in_one_block(spark, sf):
    from palimpsest.plans import base

    e = base.events(spark, sf)
    b = seal.to_blocks(seal.assign_blocks(e))
    assert b.agg(F.sum(F.size("raw_events"))).first()[0] == e.count()
    assert b.count() == b.select("block_id").distinct().count()


def test_rrf(spark):
    hits = lambda *ids: spark.createDataFrame([(1, b, 1.0, i + 1) for i, b in enumerate(ids)], "query_id bigint, block_id string, score double, rank bigint")
    got = retrieve.rrf({"keyword": (hits("a", "b"), 0.5), "vector": (hits("b", "c"), 0.5)}, 5).orderBy("rank").collect()
    assert [r.block_id for r in got] == ["b", "a", "c"]
    assert [round(r.score, 6) for r in got] == [0.016261, 0.008197, 0.008065]


EDGE = "src string, dst string, type string, confidence double"


def expand(spark, edges, seeds, blocks, **how):
    s = spark.createDataFrame([(1, x) for x in seeds], "query_id bigint, node string")
    b = spark.createDataFrame([(x,) for x in blocks], "block_id string")
    return graph.expand(s, spark.createDataFrame(edges, EDGE), b, how.pop("k", 10), **how).orderBy("rank").collect()


def test_graph_confidence_order(spark):
    got = expand(spark, [("a", "b", "CONTEXT", 0.95), ("a", "c", "CONTEXT", 0.2), ("a", "d", "CAUSES", 1.0)], ["a"], "abcd", direction="outgoing")
    assert [r.block_id for r in got] == ["b", "c"] and got[0].score == 1.0


def test_graph_star(spark):
    got = expand(spark, [("s", f"b-{i}", "CONTEXT", (i + 1) / 1200) for i in range(1200)], ["s"], [f"b-{i}" for i in range(1200)])
    assert [r.block_id for r in got] == [f"b-{i}" for i in range(1199, 1189, -1)]


def test_graph_empty_and_file_nodes(spark):
    assert [r.block_id for r in expand(spark, [("s", "", "X", None), ("", "b", "Y", None)], ["s"], ["s", "b"], types=[], depth=2, direction="outgoing")] == ["b"]
    assert [r.block_id for r in expand(spark, [("s", "file:x", "X", None), ("s", "b", "Y", None)], ["s"], ["s", "b", "file:x"], types=[])] == ["b"]


def test_graph_against_plain_python(spark):
    rng = np.random.default_rng(1)
    edges = list({(f"n{a}", f"n{b}", t): (f"n{a}", f"n{b}", t, float(rng.random())) for a, b, t in zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60), rng.choice(["CONTEXT", "FOLLOWS", "CAUSES"], 60))}.values())
    seeds = ["n0", "n1", "n1"]
    front, total = {}, {}
    for s in seeds:
        front[s] = front.get(s, 0) + 1 / len(seeds)
    for step in (1, 2):
        after = {}
        for node, mass in front.items():
            out = [(d, c) for s, d, _, c in edges if s == node] + [(s, c) for s, d, _, c in edges if d == node]
            for target, c in out:
                after[target] = after.get(target, 0) + mass / len(out) * 0.88 ** (step - 1) * min(1, max(0.05, c))
        for n, m in after.items():
            total[n] = total.get(n, 0) + m
        front = after
    for s in seeds:
        total.pop(s, None)
    got = expand(spark, edges, seeds, [f"n{i}" for i in range(12)], types=[], depth=2, k=20)
    assert {r.block_id: round(r.score, 9) for r in got} == {n: round(m / max(total.values()), 9) for n, m in total.items()}


def test_walk_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b", "X", None), ("a", "c", "X", None), ("a", "c", "Y", None), ("b", "d", "X", None)], EDGE)
    s = spark.createDataFrame([(1, "a"), (1, "a")], "query_id bigint, node string")
    got = {r.node: r.p for r in graph.walk(s, e).collect()}
    assert got == pytest.approx({"b": 0.5 / 1.375, "c": 0.5 / 1.375, "d": 0.375 / 1.375})


def test_traverse(spark):
    e = spark.createDataFrame([("a", "b", "X", None), ("b", "c", "Y", None), ("d", "a", "X", None)], EDGE)
    s = spark.createDataFrame([(1, "a")], "query_id bigint, node string")
    nodes = lambda **how: {r.node: r.step for r in graph.traverse(s, e, **how).collect()}
    assert nodes(direction="outgoing", depth=5) == {"a": 0, "b": 1, "c": 2}
    assert nodes(depth=1) == {"a": 0, "b": 1, "d": 1} and nodes(types=["X"], depth=3) == {"a": 0, "b": 1, "d": 1}


def test_predict(spark):
    b = spark.createDataFrame([("a", ["k1", "k2", "k3", "k4"], "s", [1.0, 0.0]), ("b", [], "a summary that is longer than that", [0.0, 1.0]), ("c", [], "", [0.0, 1.0])], "block_id string, keywords array<string>, summary string, embedding array<double>")
    e = spark.createDataFrame([("a", "b", "X", None), ("a", "c", "X", None), ("b", "a", "X", None)], EDGE)
    got = graph.predict(spark.createDataFrame([(1, "a"), (1, "unknown")], "query_id bigint, node string"), b, e)
    assert [(r.block_id, r.label) for r in got["intents"].orderBy("rank").collect()] == [("b", "a summary that is longer"), ("c", "c"), ("a", "k1/k2/k3")]
    v = got["vectors"].first().vector
    assert np.linalg.norm(v) == pytest.approx(1)


def test_exact_vectors_and_recall(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(400, 16))
    b = spark.createDataFrame([(f"b{i:03d}", r.tolist()) for i, r in enumerate(m)], "block_id string, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, (m[i] + 0.1).tolist()) for i in range(20)], "query_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.block_id for r in retrieve.vector_topk(q, b, 5).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(20):
        s = u @ ((m[i] + 0.1) / np.linalg.norm(m[i] + 0.1))
        assert [got[i, k] for k in range(1, 6)] == [f"b{j:03d}" for j in np.argsort(-s)[:5]]
    near = {(r.query_id, r.block_id) for r in retrieve.lsh_topk(q, b, 1, 16).collect()}
    assert sum((i, f"b{i:03d}") in near for i in range(20)) >= 18


def test_lsh_small(spark):
    b = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("bad", [float("nan"), 1.0])], "block_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<double>")
    assert [r.block_id for r in retrieve.lsh_topk(q, b, 2, 2, min_score=0.5, backfill=False).collect()] == ["x"]


def clustered(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dim))
    m[: n // 3] = m[0] + 0.05 * rng.normal(size=(n // 3, dim))  # a third of all vectors in one bucket
    return m


def test_lsh_buckets_on_clustered_vectors(spark):
    m, k = clustered(1500, 16, 60, 4), 5
    b = spark.createDataFrame([(f"b{i:04d}", r.tolist()) for i, r in enumerate(m)], "block_id string, embedding array<double>").repartition(6)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 1500, 20)], "query_id bigint, embedding array<double>")
    got = retrieve.lsh_topk(q, b, k, 16, backfill=False)
    exact = {(r.query_id, r.block_id): r.score for r in retrieve.vector_topk(q, b, k).collect()}
    rows = {(r.query_id, r.block_id): r.score for r in got.collect()}
    assert len(rows.keys() & exact.keys()) / len(exact) >= 0.9
    assert all(rows[p] == exact[p] for p in rows.keys() & exact.keys())
    # Candidates by plain loops over the keys: what the join may score, and nothing else is in the result.
    keys = vectors.sign_keys(m, 6, 12).astype(int)
    near = lambda i, j: any(bin(a ^ c).count("1") <= 1 for a, c in zip(keys[i], keys[j], strict=True))
    candidates = {(i, f"b{j:04d}") for i in range(0, 1500, 20) for j in range(1500) if near(i, j)}
    assert rows.keys() <= candidates and len(candidates) < 0.3 * 75 * 1500
    for i in range(0, 1500, 20):
        mine = sorted((-np.round(m[i] @ m[j] / np.linalg.norm(m[i]) / np.linalg.norm(m[j]), 9), f"b{j:04d}") for j in range(1500) if (i, f"b{j:04d}") in candidates)[:k]
        assert sorted(b for q, b in rows if q == i) == sorted(b for _, b in mine)
    plan = retrieve.bucket_pairs(q, b, 16, 6, 12, 1)._jdf.queryExecution().toString()
    assert "Join Inner, ((table" in plan and "CartesianProduct" not in plan


def test_queries_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(retrieve, "QUERIES", 3)
    b = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [1.0]), ("none", None), ("empty", [])], "block_id string, embedding array<double>")
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)] + [(20, [2.0]), (21, None), (22, [])], "query_id bigint, embedding array<double>")
    got = {r.query_id: (r.block_id, r.score) for r in retrieve.vector_topk(q, b, 1).collect()}
    assert set(got) == set(range(21)) and got[0] == ("y", 1) and got[19][0] == "x" and got[20] == ("z", 1)


@pytest.mark.parametrize("small", [(7, 20), (512, 4000)])
def test_exact_vectors_by_tiles(spark, monkeypatch, small):
    monkeypatch.setattr(retrieve, "QUERIES", small[0])
    monkeypatch.setattr(retrieve, "BLOCKS", small[1])
    rng = np.random.default_rng(2)
    m = np.round(rng.normal(size=(150, 3)) * 2) / 2  # many ties
    names = [f"b{i:03d}" for i in range(150)]
    b = spark.createDataFrame([(n, r.tolist()) for n, r in zip(names, m, strict=True)], "block_id string, embedding array<double>").repartition(2)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(20)], "query_id bigint, embedding array<double>")
    got = retrieve.vector_topk(q, b, 4).orderBy("query_id", "rank").collect()
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(n > 0, n, 1)
    s = np.round(u[:20] @ u.T, 9)
    assert [(r.query_id, r.block_id) for r in got] == [(i, names[j]) for i in range(20) for j in sorted(range(150), key=lambda j: (-s[i, j], names[j]))[:4]]


def test_two_stage_early_stop(spark):
    b = spark.createDataFrame([("a", [1.0, 0.0], [0.0, 1.0]), ("b", [0.6, 0.8], [1.0, 0.0])], "block_id string, hash array<double>, local array<double>")
    q = lambda local: spark.createDataFrame([(1, [1.0, 0.0], local)], "query_id bigint, hash array<double>, local array<double>")
    first = lambda local, **c: retrieve.two_stage_topk(q(local), b, 1, 2, load(env={}, **c)).first().block_id
    assert first([1.0, 0.0]) == "a"  # the gap is wide, no rerank
    assert first([1.0, 0.0], hybrid_early_stop_min_gap=0.0) == "b" and first([0.0, 0.0], hybrid_early_stop_min_gap=0.0) == "a"


BLOCK = "session_id bigint, block_seq bigint, block_id string, start_ms bigint, end_ms bigint, token_count bigint, summary string, keywords array<string>, embedding array<double>, raw_events array<struct<event_id: string, role: string, text: string, ts_ms: bigint>>"


def blocks(spark, *rows):
    return spark.createDataFrame([(1, i, f"b{i + 1}", s, s + 10, tok, text, kw, [1.0, 0.0, 0.0], []) for i, (s, tok, kw, text) in enumerate(rows)], BLOCK)


def test_history_match(spark):
    b = blocks(spark, (0, 50, ["alpha", "beta"], "first part"), (1000, 50, ["gamma", "beta"], "then the next phase"))
    m = {r.block_id: r for r in history.match(b).collect()}
    assert m["b1"].match_score == 0 and m["b1"].novelty == 0 and m["b1"].best_id is None
    assert m["b2"].best_id == "b1" and m["b2"].affinity > 0.6 and m["b2"].novelty == pytest.approx(0.5)
    boosted = {r.block_id: r for r in history.match(b, spark.createDataFrame([("b2", "b1", "FOLLOWS")], "src string, dst string, type string")).collect()}
    assert boosted["b2"].relation_boost == pytest.approx(0.048)


def test_relations_of_incident(spark):
    b = blocks(spark, (0, 50, ["timeout"], "timeout in task service"), (1000, 50, ["timeout"], "the error because of timeout, a subtask follows"))
    got = {r.type: r.confidence for r in relations.extract(b).collect()}
    assert set(got) >= {"FOLLOWS", "CAUSES", "PARENT_TASK", "CONTEXT"} and got["FOLLOWS"] == pytest.approx(0.95)


def test_chunks(spark):
    b = blocks(spark, (0, 600, ["a"], ""), (1000, 300, ["b"], ""), (2000, 300, ["c"], ""))
    p = chunks.positions(b)
    assert {r.block_id: r.chunk_seq for r in p.collect()} == {"b1": 0, "b2": 0, "b3": 1}
    over = chunks.positions(blocks(spark, (0, 600, ["a"], ""), (1000, 600, ["A"], "")))
    assert {r.chunk_seq for r in over.collect()} == {0}
    gap = chunks.positions(blocks(spark, (0, 1, ["a"], ""), (1_000_000, 1, ["a"], "")))
    assert {r.chunk_seq for r in gap.collect()} == {0, 1}
    five = chunks.positions(blocks(spark, *[(i * 1000, 1, ["a"], "") for i in range(4)]))
    near = [r.other for r in chunks.neighbors(five, 2).filter("block_id = 'b3'").orderBy("ord").collect()]
    assert near == ["b2", "b4", "b1"]
    m = chunks.manifest(p).orderBy("chunk_seq").collect()
    assert [(r.block_ids, r.token_start, r.token_end) for r in m] == [(["b1", "b2"], 0, 900), (["b3"], 900, 1200)] and len(m[0].source_hash) == 16
    refs = spark.createDataFrame([(1, "b1", 0.9, 1)], "query_id bigint, block_id string, score double, rank bigint")
    got = chunks.expanded(refs, refs, p).orderBy("rank").collect()
    assert [(r.block_id, round(r.score, 4)) for r in got] == [("b1", 0.9), ("b2", 0.8999)]


def test_context_layout(spark, sf):
    from palimpsest.plans import base

    e = Engine(spark, load(env={}, max_tokens_per_block=120, min_tokens_per_block=40))
    ev = base.events(spark, sf).filter("session_id < 8")
    t = e.build(ev)
    q = ev.filter("role = 'user'").groupBy("session_id").agg(F.min_by("text", "seq").alias("query")).select(F.col("session_id").alias("query_id"), "session_id", "query")
    for r in e.context(q, t).collect():
        assert r.formatted.startswith("=== RETRIEVED BLOCKS ===\n#1 [block_") and "=== RECENT EVENTS ===" in r.formatted
    kept = context.backtracked(context.refs(e.retrieve(q, t)["ranked"], t.blocks), t.raw)
    assert kept.filter(F.size("raw_events") == 0).count() == 0


def test_saved_engine(spark, sf, tmp_path):
    from palimpsest.plans import base

    e = Engine(spark)
    ev = base.events(spark, sf).filter("session_id < 4")
    t = e.build(ev)
    e.save(t, str(tmp_path))
    again = e.load(str(tmp_path), ev)
    assert again.blocks.count() == t.blocks.count() and again.edges.count() == t.edges.count()


def q(now, **more):
    base = {"now": now, "first": now - 100, "last": now - 10, "source": "user", "n_tokens": 5, "keywords": ["alpha", "beta"], "embedding": [1.0, 0.0], "top_ids": ["a", "b"], "graph_ids": [], "graph_confidence": 0.0, "prediction_weight": 0.5, "predicted": True, "active": False, "sparse": False, "intents": [], "top_embedding": [1.0, 0.0]}
    return base | more


def test_short_chain_streak():
    d = detect.Detector()
    got = [d.step(q(i * 10, intents=[("a", 1.0)]))["reason"] for i in range(5)]
    assert got[:3] == ["relation_short_chain_soft_triggered"] * 2 + ["relation_short_chain_hard_triggered"] and d.relation_streak == 5
    assert got[3] != "relation_short_chain_hard_triggered"
    assert d.step(q(2000, intents=[("a", 1.0)]))["reason"] == "relation_short_chain_hard_triggered"


def test_topic_shift_and_cooldown():
    d = detect.Detector()
    step = lambda now, **m: d.shift(q(now, **m))
    assert step(0)[1] == "topic_shift_baseline_unavailable" and step(10)[1] == "topic_shift_not_met"
    assert step(20, n_tokens=2)[1] == "topic_shift_query_not_informative"
    other = {"keywords": ["x", "y"], "embedding": [0.0, 1.0], "top_ids": ["z"]}
    assert step(30, **other) == ("hard", "topic_shift_hard")
    assert step(40)[1] == "topic_shift_hard_cooldown_blocked" and step(700, **other)[0] == "hard"
    assert step(710, source="timer")[1] == "topic_shift_non_user_trigger"


def test_low_entropy_streak():
    d = detect.Detector()
    got = [d.low_entropy(q(i * 1000, prediction_weight=0.0))[1] for i in range(6)]
    assert got[0] == "low_entropy_not_met" and got[1] == "low_entropy_streak_accumulating" and got[2] == "low_entropy_soft" and got[4] == "low_entropy_hard"


def test_gate_and_prefetch():
    d = detect.Detector()
    sure = [("a", 0.97), ("b", 0.01), ("c", 0.01), ("d", 0.01)]
    assert d.gate(q(1000, active=True, intents=sure))[3] == "inject_ready"
    assert d.gate(q(1050, active=True, intents=sure))[3] == "timing_blocked:cooldown"
    assert d.gate(q(3000, last=2000, active=True, intents=sure))[3] == "prefetch_only"
    assert d.prefetch_boosts(3100) == {"a": pytest.approx(0.97 * 0.25 * 0.6)} and d.prefetch_boosts(3200) == {}
    assert d.gate(q(9000, last=0, active=True, intents=sure))[3] == "timing_blocked:idle_too_long"
    assert d.gate(q(0, predicted=False))[3] == "no_prediction" and d.gate(q(0, sparse=True))[3] == "keyword_sparse_priority"


@pytest.mark.parametrize("histories, want", [([[], []], [1, 1]), ([[0.5] * 4, [0.5] * 4], [1, 1]), ([[0.5] * 4, [0, 1, 0, 1]], [2.0, 0.5])])
def test_signal_weights(histories, want):
    assert detect.signal_weights(histories) == pytest.approx(want)


def test_wakeup_budget(spark):
    now = [0, 100, 600, 1200, 1800, 3600, 3601, 4201]  # what was admitted an hour ago still counts, a second later it does not
    df = spark.createDataFrame([(1, n) for n in now], "session_id bigint, now bigint")
    assert [r.admitted for r in detect.planned(df).orderBy("now").collect()] == [True, False, True, True, False, False, True, True]


def test_hyperplanes_are_units():
    p = vectors.hyperplanes(8)
    assert p.shape == (6, 12, 8) and np.allclose(np.linalg.norm(p, axis=2), 1)
    assert np.linalg.norm(vectors.relation_vector("odd type", 5)) == pytest.approx(1)


def test_search_plan(spark):
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta gamma")], "query_id bigint, query string")
    found = spark.createDataFrame([(1, 1, "alpha then more", ["alpha", "zeta"]), (1, 2, "other", [])], "query_id bigint, rank bigint, summary string, keywords array<string>")
    got = {r.query_id: r.searches for r in context.search_plan(queries, found).collect()}
    assert got == {1: ["alpha beta", "other", "zeta"], 2: ["gamma delta gamma", "delta", "gamma"]}


def test_file_links(spark):
    b = spark.createDataFrame([("b1",)], "block_id string")
    m = spark.createDataFrame([("b1", "x.py", "v1"), ("gone", "x.py", "v1"), ("b1", "", "v")], "block_id string, path string, version string")
    assert sorted(map(tuple, relations.file_links(b, m).collect())) == [("file:x.py", "b1", "FILE_MENTIONS_BLOCK", 0.75), ("snapshot:x.py#v1", "file:x.py", "SNAPSHOT_OF_FILE", 1.0)]


def test_command_line(spark, tmp_path, capsys):
    from palimpsest.__main__ import main

    (tmp_path / "in.jsonl").write_text('{"role": "user", "text": "the database failed"}\n{"role": "assistant", "text": "restart the database"}\nbroken\n')
    main(["ingest", str(tmp_path / "in.jsonl"), str(tmp_path / "t"), "--seal-every", "1"], spark)
    assert "2 records, 1 skipped" in capsys.readouterr().out
    main(["ask", str(tmp_path / "t"), "database"], spark)
    out = capsys.readouterr().out
    assert "#1 [block_" in out and "evidence:\n- " in out
    main(["stats", str(tmp_path / "t")], spark)


def test_depth_zero(spark):
    e = spark.createDataFrame([("a", "b", "X", None)], EDGE)
    s = spark.createDataFrame([(1, "a")], "query_id bigint, node string")
    assert expand(spark, [("a", "b", "X", None)], ["a"], "ab", depth=0) == [] and graph.walk(s, e, 0).count() == 0


def test_graph_shares_are_alike_with_one_way_for_all(spark):
    """Degrees from the edges, or counted query by query where each query goes its own way."""
    rng = np.random.default_rng(3)
    edges = [(f"n{a}", f"n{b}", "CONTEXT", float(c)) for a, b, c in zip(rng.integers(0, 9, 40), rng.integers(0, 9, 40), rng.random(40))]
    e, b = spark.createDataFrame(edges, EDGE), spark.createDataFrame([(f"n{i}",) for i in range(9)], "block_id string")
    s = spark.createDataFrame([(1, "n0"), (2, "n3"), (2, "n4")], "query_id bigint, node string")
    own = s.withColumns({"direction": F.lit("both"), "types": F.array(F.lit("CONTEXT"))})
    rows = lambda seeds: sorted((r.query_id, r.block_id, round(r.score, 9)) for r in graph.expand(seeds, e, b, 9, types=["CONTEXT"], depth=2).collect())
    assert rows(s) == rows(own) != []


def test_ties_without_end(spark):
    b = spark.createDataFrame([(f"b{i:03d}", [0.0, 0.0] if i % 3 else [1.0, 0.0]) for i in range(200)], "block_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], "query_id bigint, embedding array<double>")
    got = {}
    for r in retrieve.vector_topk(q, b, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.block_id)
    assert got == {1: ["b000", "b003", "b006", "b009"], 2: ["b000", "b001", "b002", "b003"], 3: ["b000", "b001", "b002", "b003"]}


@pytest.fixture(scope="module")
def talk(spark):
    """Three sessions of short turns; the last turn of the first one is about something of its own."""
    rows = [(s, i, "user" if i % 2 == 0 else "assistant", f"session{s} topic{i} about database index number{i}", 1000 * i) for s in range(3) for i in range(6)]
    rows.append((0, 6, "user", "unicorn glacier saxophone", 9000))
    return spark.createDataFrame(rows, EV)


def asked(spark, *rows):
    return spark.createDataFrame([(i, s, t, i, 100 + 10 * i, "user") for i, (s, t) in enumerate(rows)], "query_id bigint, session_id bigint, query string, seq bigint, now bigint, source string")


def test_open_blocks_in_retrieval_and_context(spark, talk):
    e = Engine(spark)
    t = e.build(talk, seal_every=1, keep_open=True)
    assert t.opened.count() == 3 and t.blocks.count() == 16
    q = asked(spark, (0, "unicorn saxophone glacier"), (1, "unicorn saxophone glacier"))
    best = {r.query_id: (r.block_id, r.score) for r in e.retrieve(q, t)["ranked"].filter("rank = 1").collect()}
    assert best[0][0] == "block_0000000000_000006" and best[0][1] == pytest.approx(1.0)  # the same words
    assert best.get(1, ("",))[0] != "block_0000000000_000006"
    text = {r.query_id: r.formatted for r in e.context(q, t).collect()}
    assert "#1 [block_0000000000_000006] score=1.000 retention=raw" in text[0] and "unicorn" in text[0]


def test_boosts_and_neighbours_in_retrieval(spark, talk):
    e = Engine(spark, load(env={}, chunk_neighbor_expand=True, chunk_neighbor_score_gate=0.0, chunk_max_expanded_blocks=2, final_top_k=1))
    t = e.build(talk, seal_every=1)
    q = asked(spark, (1, "session1 topic3 number3"))
    plain = e.retrieve(q, t)["ranked"].orderBy("rank").collect()
    at = int(plain[0].block_id[-6:])
    assert [r["rank"] for r in plain] == [1, 2, 3] and {r.block_id for r in plain[1:]} == {f"block_0000000001_{n:06d}" for n in (at - 1, at + 1)}
    boosts = spark.createDataFrame([(0, "block_0000000002_000000", 5.0)], "query_id bigint, block_id string, boost double")
    first = e.retrieve(q, t, boosts)["ranked"].filter("rank = 1").first()
    assert first.block_id == "block_0000000002_000000" and first.score >= 5.0


def test_signals_in_context(spark, talk):
    e = Engine(spark)
    t = e.build(talk, seal_every=1)
    q = asked(spark, (1, "session1 topic3 database index"), (1, "unicorn glacier saxophone"), (1, e.cfg.timer_probe_query))
    signals, boosts = e.signals(q, t)
    assert signals.count() == 3 and boosts.columns == ["query_id", "block_id", "boost"]
    for r in e.context(q, t, signals, boosts).collect():
        assert "=== PROACTIVE SIGNAL ===\nallowWakeup=" in r.formatted and "triggerSource=user" in r.formatted


@pytest.mark.parametrize("how", ["lsh", "exact"])
def test_vector_search_by_configuration(spark, talk, how):
    e = Engine(spark, load(env={}, vector_search=how))
    t = e.build(talk, seal_every=1)
    assert e.retrieve(asked(spark, (1, "session1 topic3 number3")), t)["semantic"].filter("rank = 1").first().block_id == "block_0000000001_000003"
    with pytest.raises(ValueError):
        load(env={}, vector_search="other")


def test_two_stage_by_configuration(spark):
    b = spark.createDataFrame([("a", 0, ["k"], [1.0, 0.0], [0.0, 1.0]), ("b", 1, ["z"], [0.9, 0.1], [1.0, 0.0])], "block_id string, block_seq bigint, keywords array<string>, hash array<double>, local array<double>")
    q = spark.createDataFrame([(1, ["none"], [1.0, 0.0], [1.0, 0.0])], "query_id bigint, keywords array<string>, hash array<double>, local array<double>")
    got = retrieve.semantic_topk(q, b, load(env={}, vector_search="two_stage", hybrid_early_stop_min_gap=0.5)).orderBy("rank").collect()
    assert got[0].block_id == "b"


def test_staged_boosts(spark):
    """A prediction that is only prefetched lifts its blocks at the next query, once."""
    log = [(1, i, now, 0, 2000, "user", 5, ["alpha", "beta"], [1.0, 0.0], ["a"], [], 0.0, 0.5, True, True, False, [("a", 0.97), ("b", 0.01), ("c", 0.01), ("d", 0.01)], [1.0, 0.0]) for i, now in enumerate((3000, 3050, 3060))]
    got = detect.staged(spark.createDataFrame(log, detect.LOG)).collect()
    assert [(r.seq, r.block_id, round(r.boost, 6)) for r in got] == [(1, "a", round(0.97 * 0.25 * 0.6, 6))]
