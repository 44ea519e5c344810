"""Streams with state that expires: staged predictions, wake-ups, and the relation queue with its dead letters."""

import json
from collections import deque

from palimpsest.operators import detect, graph
from palimpsest.sources import tables
from palimpsest.sources.config import DEFAULT
from palimpsest.streaming import proactive, relation_queue, sealing, stateful


def run(stream, at):
    rows = []
    with sealing.with_state(stream.sparkSession):
        q = stream.writeStream.option("checkpointLocation", f"{at}/cp").outputMode("append").trigger(availableNow=True).foreachBatch(lambda b, _: rows.extend(b.collect())).start()
        q.awaitTermination()
    return rows


def arrive(spark, rows, schema, at):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")


def state(spark, at, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{at}/cp").count()


def query(s, i, now, staged=True, ttl_test=False):
    """A query whose gate prefetches: quiet for 10 minutes, sure of one of its intents."""
    return (s, i, now, now - 2000, now - 600, "user", 5, [f"k{i}"], [1.0, 0.0], [], [], 0.0, 0.0, True, True, False, [("b1", 0.9), ("b2", 0.02)] if staged else [], [1.0, 0.0])


def test_staged_predictions_equal_the_batch_and_expire(spark, tmp_path):
    at = str(tmp_path)
    rows = [query(1, 0, 10_000), query(1, 1, 10_200), query(2, 0, 10_100), query(3, 0, 10_000), query(3, 1, 11_801), query(4, 0, 10_000), query(4, 1, 11_800)]
    read = lambda: proactive.boost_stream(spark.readStream.schema(detect.LOG).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"))
    got = []
    for i in (0, 1):
        arrive(spark, [r for r in rows if r[1] == i], detect.LOG, at)
        got += run(read(), at)
        assert state(spark, at, "trigger") > 0
    want = detect.staged(spark.createDataFrame(rows, detect.LOG)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.session_id for r in got} == {1, 4}  # a second over its time session 3 has nothing
    assert state(spark, at, "staged") > 0
    arrive(spark, [query(9, 0, 50_000, staged=False)], detect.LOG, at)
    assert run(read(), at) == []
    assert spark.read.format("statestore").option("stateVarName", "trigger").load(f"{at}/cp").select("key.session_id").distinct().collect()[0][0] == 9
    assert state(spark, at, "trigger") == 1 and state(spark, at, "staged") == 0


def ticks(moments, end, interval, forget, cfg=DEFAULT):
    """Wake-ups of one session by plain loops: quiet stretches between activity, ticked every interval."""
    out, given = [], deque()
    for last, until in zip(moments, [*moments[1:], end], strict=True):
        now = last + interval
        while now < until and now - last <= forget:
            while given and now - given[0] > 3600:
                given.popleft()
            ok = (not given or now - given[-1] >= cfg.proactive_wakeup_min_interval_seconds) and len(given) < cfg.proactive_wakeup_max_per_hour
            if ok:
                given.append(now)
            out.append((now, now - last, ok))
            now += interval
    return out


def test_wakeups_of_quiet_sessions(spark, tmp_path):
    at, schema = str(tmp_path), "session_id long, now long"
    moments = {1: [10, 10_000], 2: [9_000], 3: [100, 200, 10_100]}
    read = lambda: proactive.wakeup_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), interval=300, forget=6000, late="0 seconds")
    got = []
    for rows in ([(1, 10), (3, 100), (3, 200)], [(2, 9_000)], [(1, 10_000), (3, 10_100)], [(7, 20_000)]):
        arrive(spark, rows, schema, at)
        got += run(read(), at)
    for s, own in moments.items():
        want = ticks(own, 20_000, 300, 6000)
        assert sorted((r.now, r.idle_seconds, r.admitted) for r in got if r.session_id == s) == want and want
    assert state(spark, at, "state") == 1  # the one that was just active


def test_relation_queue(spark, tmp_path):
    at, schema = str(tmp_path), "block_id string, payload string, ts_ms long"
    good = [{"src": "b1", "dst": "b2", "type": "context", "confidence": 0.8}, {"src": " b1 ", "type": "FOLLOWS"}, {"src": "b1", "dst": "b2", "type": "CONTEXT", "confidence": 0.1}, {"dst": "b9"}, None]
    batches = [
        [("b3", json.dumps(good), 10), ("b4", "{not json", 11), (None, "[]", 12), ("b5", None, 13), ("b6", "[]", 14)],
        [("b7", json.dumps([{"src": "b1", "dst": "b2", "type": "CONTEXT", "confidence": 0.95}]), 20)],
    ]
    each = relation_queue.queue(at)
    for n, rows in enumerate(batches):
        arrive(spark, rows, schema, at)
        stateful.run_once(spark.readStream.schema(schema).parquet(f"{at}/in"), "", f"{at}/cp", each)
        edges = {(r.src, r.dst, r.type): (r.ts_ms, r.confidence) for r in tables.load_kept(spark, at, "relations").collect()}
        assert edges == {("b1", "b2", "CONTEXT"): ((10, 0.8), (20, 0.95))[n], ("b1", "b3", "FOLLOWS"): (10, 0.5)}
    dead = sorted((r.block_id or "", r.reason) for r in relation_queue.dead_letters(spark, at).collect())
    assert dead == [("", "no block"), ("b4", "not a list of relations"), ("b5", "no payload")]
    each(spark.createDataFrame(batches[1], schema), 1)  # again
    each(spark.createDataFrame(batches[0][1:2], schema), 0)
    assert {(r.src, r.dst, r.type): (r.ts_ms, r.confidence) for r in tables.load_kept(spark, at, "relations").collect()} == edges
    assert relation_queue.dead_letters(spark, f"{at}/none").count() == 0


def test_closure_of_a_chain_and_a_ring(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(25)] + [("r0", "r1"), ("r1", "r2"), ("r2", "r0")]
    edges = spark.createDataFrame([(a, b, "FOLLOWS", 0, 1.0) for a, b in chain], "src string, dst string, type string, ts_ms long, confidence double")
    seeds = spark.createDataFrame([(1, "n0"), (2, "n20"), (3, "r1"), (4, "nowhere")], "query_id long, node string")
    got = graph.closure(seeds, edges, "outgoing")
    want = [(1, f"n{i}", i) for i in range(26)] + [(2, f"n{20 + i}", i) for i in range(6)] + [(3, "r1", 0), (3, "r2", 1), (3, "r0", 2), (4, "nowhere", 0)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(got._jdf.queryExecution().analyzed().toString().splitlines()) < 20
    near = graph.traverse(seeds, edges, "outgoing", depth=6)
    assert sorted(map(tuple, near.collect())) == sorted(w for w in want if w[2] <= 6)
