"""Graph steps read and deal out the edges once a step, and give what plain loops give."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph

EDGES = [(f"n{i % 13}", f"n{(i * i + 3) % 17}", ("FOLLOWS", "CONTEXT", "CAUSES")[i % 3], None if i % 4 else 0.5) for i in range(60)] + [("n1", "n1", "FOLLOWS", 0.9), ("n2", "n5", "FOLLOWS", 0.2), ("n2", "n5", "FOLLOWS", 0.7)]
SEEDS = [(q, f"n{(q * 5 + j) % 17}") for q in range(4) for j in range(1 + q % 2)]


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame(SEEDS, "query_id long, node string")


def counting(spark):
    """Edges that count how often they are read."""
    seen = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda t: seen.add(1) or t).asNondeterministic()
    return seen, spark.createDataFrame(EDGES, "src string, dst string, type string, confidence double").withColumn("src", mark("src"))


def test_traverse(spark, seeds):
    seen, e = counting(spark)
    near = defaultdict(set)
    for s, d, *_ in EDGES:
        near[s].add(d)
        near[d].add(s)
    want = {}
    for q, n in SEEDS:
        want[q, n] = 0
    for step in (1, 2, 3):
        for (q, n), at in list(want.items()):
            if at == step - 1:
                for m in near[n]:
                    want.setdefault((q, m), step)
    got = graph.traverse(seeds, e, depth=3).collect()
    assert {(r.query_id, r.node): r.step for r in got} == want and len(got) == len(want)
    assert seen.value <= 3 * 2 * len(EDGES)


def test_walk(spark, seeds):
    seen, e = counting(spark)
    near = defaultdict(set)
    for s, d, *_ in EDGES:
        near[s].add(d)
    total, front = defaultdict(float), {(q, n): 1 / sum(1 for x, _ in SEEDS if x == q) for q, n in SEEDS}
    for step in range(2):
        there = defaultdict(float)
        for (q, n), p in front.items():
            for m in near[n]:
                there[q, m] += p / len(near[n]) * 0.75**step
        front = there
        for k, p in there.items():
            total[k] += p
    of = defaultdict(float)
    for (q, _), p in total.items():
        of[q] += p
    got = graph.walk(seeds, e).collect()
    assert {(r.query_id, r.node): r.p for r in got} == pytest.approx({k: p / of[k[0]] for k, p in total.items()}) and len(got) == len(total)
    assert seen.value <= 2 * len(EDGES)


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
def test_expand(spark, seeds, direction):
    """Against seeds that each carry their own direction and types, which go the other way through the edges."""
    seen, e = counting(spark)
    blocks = spark.createDataFrame([(f"n{i}",) for i in range(0, 17, 2)] * 2, "block_id string")
    rows = lambda x: {(r.query_id, r.block_id): (round(r.score, 9), r["rank"]) for r in x.collect()}
    got = rows(graph.expand(seeds, e, blocks, 5, direction, ["FOLLOWS", "CAUSES"], 2))
    assert seen.value <= 2 * (2 if direction == "both" else 1) * len(EDGES)
    own = seeds.withColumn("direction", F.lit(direction)).withColumn("types", F.array(F.lit("FOLLOWS"), F.lit("CAUSES")))
    assert got == rows(graph.expand(own, e, blocks, 5, depth=2, direction="any")) and got


def test_the_last_step_is_planned_without_those_before(spark, seeds):
    """Its join, its sum and what a window needs, and no frontier worked out again: exchanges of the plan, of which the steps before have none."""
    e = spark.createDataFrame(EDGES, "src string, dst string, type string, confidence double")
    exchanges = lambda x: x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    for depth in (2, 3, 4):
        assert exchanges(graph.traverse(seeds, e, depth=depth)) <= 3
        assert exchanges(graph.walk(seeds, e, depth)) <= 4
