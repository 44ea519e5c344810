"""Graph steps over typed edges: traversal, weighted expansion, random walk, graph embeddings.

Each step is a join of the frontier with the edges and a sum by target; frontiers are pre-aggregated, and
one that is used twice is a checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.functions import vectors
from palimpsest.sources.config import DEFAULT, Config
from palimpsest.storage import durable

DECAY = 0.88


def is_block(node: Column) -> Column:
    return ~(F.startswith(node, F.lit("file:")) | F.startswith(node, F.lit("snapshot:")))


def arcs(edges: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """node, target, type, confidence: edges as seen from a node.  types: None is CONTEXT and FOLLOWS, [] all.

    Seen both ways an edge counts once from each of its ends.  Stored confidences are clamped, missing ones
    go by type.
    """
    types = ["CONTEXT", "FOLLOWS"] if types is None else types
    e = edges.filter(F.col("type").isin(types)) if types else edges
    e = e.groupBy("src", "dst", "type").agg(F.max(S.edge_confidence(F.col("type"), F.col("confidence"))).alias("confidence"))
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("target"), "type", "confidence")
    back = e.select(F.col("dst").alias("node"), F.col("src").alias("target"), "type", "confidence")
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def pairs(edges: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """node, target as in arcs, repeats included: what follows sums or takes each node once, so the edges are not dealt out for it."""
    e = edges.filter(F.col("type").isin(types)) if types else edges
    out, back = (e.select(F.col(a).alias("node"), F.col(b).alias("target")) for a, b in (("src", "dst"), ("dst", "src")))
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def traverse(seeds: DataFrame, edges: DataFrame, direction: str = "both", types: list[str] | None = None, depth: int = 1) -> DataFrame:
    """query_id, node, step: all nodes within depth steps of the seeds (query_id, node), at their first step; seeds are step 0.

    A step is one join and one sum, which finds both what is new and what was seen, and what was seen is saved in between.
    """
    if depth > 4:
        return closure(seeds, edges, direction, types, depth)
    a = pairs(edges, direction, types)
    seen = seeds.select("query_id", "node").distinct().withColumn("step", F.lit(0))
    for step in range(1, depth + 1):
        seen = durable(seen) if step > 1 else seen
        reached = seen.filter(F.col("step") == step - 1).join(a, "node").select("query_id", F.col("target").alias("node"), F.lit(step).alias("step"))
        seen = seen.unionByName(reached).groupBy("query_id", "node").agg(F.min("step").alias("step"))
    return seen


def closure(seeds: DataFrame, edges: DataFrame, direction: str = "both", types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """As traverse, to the end (or most steps): each step reads the saved frontier of the one before, and an empty one ends it.

    What was seen is the saved frontiers side by side, put together in one table every eighth step, so that no
    plan grows with the number of steps.
    """
    a = durable(arcs(edges, direction, [] if types is None else types).select("node", "target").distinct())
    front = seen = durable(seeds.select("query_id", "node").distinct().withColumn("step", F.lit(0)))
    step = 0
    while most is None or step < most:
        step += 1
        reached = front.join(a, "node").select("query_id", F.col("target").alias("node")).distinct()
        front = durable(reached.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("step", F.lit(step)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        seen = durable(seen) if step % 8 == 0 else seen
    return seen


def expand(seeds: DataFrame, edges: DataFrame, blocks: DataFrame, k: int, direction: str = "both", types: list[str] | None = None, depth: int = 1) -> DataFrame:
    """query_id, block_id, score, rank: mass that spreads from the seeds over edges, over the highest of the query.

    seeds: query_id, node, with repeats that count; with columns direction and types each query goes its own
    way.  A node's mass is shared evenly by its edges, weighed by their confidence and 0.88 a step.  Seeds,
    files and nodes that are no block are left out.
    """
    if depth < 1:  # goes nowhere
        return seeds.select("query_id", F.col("node").alias("block_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank")).filter("false")
    alike = "direction" not in seeds.columns
    if alike:  # a node's edges are the same for every query
        a, way = _weighed(edges, direction, ["CONTEXT", "FOLLOWS"] if types is None else types), []
        how = seeds.groupBy("query_id").agg(F.count("*").alias("m"))
    else:
        out, back = arcs(edges, "outgoing", []).withColumn("way", F.lit("outgoing")), arcs(edges, "incoming", []).withColumn("way", F.lit("incoming"))
        a, way = {"outgoing": out, "incoming": back}.get(direction, out.unionByName(back)), ["direction", "types"]
        how = seeds.groupBy("query_id").agg(F.first("direction").alias("direction"), F.first("types").alias("types"), F.count("*").alias("m"))
    front = seeds.groupBy("query_id", "node").agg(F.count("*").alias("c")).join(how, "query_id").select("query_id", "node", *way, (F.col("c") / F.col("m")).alias("mass"))
    total = None
    for step in range(1, depth + 1):
        x = front.join(a, "node")
        if not alike:
            x = x.filter(((F.col("direction") == "both") | (F.col("direction") == F.col("way"))) & ((F.size("types") == 0) | F.array_contains("types", F.col("type"))))
            x = x.withColumn("n", F.count("*").over(Window.partitionBy("query_id", "node")))
        share = F.col("mass") / F.col("n") * DECAY ** (step - 1) * F.col("confidence")
        front = x.select("query_id", *way, F.col("target").alias("node"), share.alias("mass"))
        if step < depth:  # used twice
            front = durable(front.groupBy("query_id", *way, "node").agg(F.sum("mass").alias("mass")))
        own = front.select("query_id", "node", "mass")
        total = own if total is None else total.unionByName(own)
    x = total.groupBy("query_id", "node").agg(F.sum("mass").alias("mass")).join(seeds.select("query_id", "node").distinct(), ["query_id", "node"], "left_anti")
    known = blocks.select(F.col("block_id").alias("node")).distinct().withColumn("_known", F.lit(True))
    x = x.join(known, "node", "left")  # before the highest mass is sought, so that both windows go by one order of the rows
    top = F.max("mass").over(Window.partitionBy("query_id"))
    x = x.withColumn("score", F.when(top > 0, F.col("mass") / top).otherwise(F.col("mass")))
    x = x.filter(F.col("_known") & is_block(F.col("node")))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "node")
    return x.select("query_id", F.col("node").alias("block_id"), "score", F.row_number().over(w).cast("long").alias("rank")).filter(F.col("rank") <= k)


def _weighed(edges: DataFrame, direction: str, types: list[str]) -> DataFrame:
    """node, target, confidence, n (of the node's arcs), as from arcs(); dealt out once, by node, as the steps join them."""
    e = edges.filter(F.col("type").isin(types)) if types else edges
    ways = {"outgoing": ["src"], "incoming": ["dst"]}.get(direction, ["src", "dst"])
    parts = [e.select(F.col(w).alias("node"), F.col("dst" if w == "src" else "src").alias("target"), "type", F.lit(w).alias("way"), S.edge_confidence(F.col("type"), F.col("confidence")).alias("c")) for w in ways]
    x = reduce(DataFrame.unionByName, parts).repartition("node").groupBy("node", "target", "type", "way").agg(F.max("c").alias("confidence"))
    return x.select("node", "target", "confidence", F.count("*").over(Window.partitionBy("node")).alias("n"))


def walk(seeds: DataFrame, edges: DataFrame, depth: int = 2, decay: float = 0.75) -> DataFrame:
    """query_id, node, p: where a walk over distinct out-neighbours goes within depth steps; p sums to 1 a query."""
    a = pairs(edges, "outgoing").repartition("node").distinct()  # dealt out once, by node, as the steps join them
    a = a.withColumn("n", F.count("*").over(Window.partitionBy("node")))
    s = seeds.select("query_id", "node").distinct()
    front = s.join(s.groupBy("query_id").agg(F.count("*").alias("m")), "query_id").select("query_id", "node", (1 / F.col("m")).alias("p"))
    total = None
    for step in range(1, depth + 1):
        front = front.join(a, "node").select("query_id", F.col("target").alias("node"), (F.col("p") / F.col("n") * decay ** (step - 1)).alias("p"))
        if step < depth:  # used twice
            front = durable(front.groupBy("query_id", "node").agg(F.sum("p").alias("p")))
        total = front if total is None else total.unionByName(front)
    if total is None:  # depth 0 goes nowhere
        return s.select("query_id", "node", F.lit(0.0).alias("p")).filter("false")
    x = total.groupBy("query_id", "node").agg(F.sum("p").alias("p"))
    return x.select("query_id", "node", (F.col("p") / F.sum("p").over(Window.partitionBy("query_id"))).alias("p"))


def embed_nodes(blocks: DataFrame, edges: DataFrame, method: str = "mean", wanted: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """block_id, vector: a block's embedding mixed with its neighbours', at unit length.

    mean (also named node2vec): 0.65 own and 0.35 the mean of distinct neighbours.  translate: 0.6 own and 0.4
    the mean over typed edges of the neighbour less the type's vector (outgoing) or with it (incoming).
    wanted (block_id): only these, each once.
    """
    if dim is None:
        first = blocks.filter(F.size("embedding") > 0).select(F.size("embedding").alias("n")).limit(1).collect()
        dim = first[0].n if first else 256
    zero = F.array_repeat(F.lit(0.0), dim)
    fit = F.slice(F.concat(F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>")), zero), 1, dim)
    every = blocks.select("block_id", fit.alias("e"))
    own = every if wanted is None else every.join(wanted, "block_id", "left_semi")
    out = edges.select(F.col("src").alias("block_id"), F.col("dst").alias("other"), "type", F.lit(-1.0).alias("sign"))
    both = out.unionByName(edges.select(F.col("dst").alias("block_id"), F.col("src").alias("other"), "type", F.lit(1.0).alias("sign")))
    both = both if wanted is None else both.join(wanted, "block_id", "left_semi")
    near = every.select(F.col("block_id").alias("other"), F.col("e").alias("v"))
    if method in ("mean", "node2vec"):
        x, a, b = both.select("block_id", "other").distinct().join(near, "other"), 0.65, 0.35
    elif method == "translate":
        kinds = [r.type for r in edges.select("type").distinct().limit(10_001).collect()]
        if len(kinds) > 10_000:
            raise ValueError("over 10,000 relation types")
        table = edges.sparkSession.createDataFrame([(t, vectors.relation_vector(t, dim)) for t in kinds], "type string, r array<double>")
        x = both.distinct().join(near, "other").join(F.broadcast(table), "type")  # at most 10,000 types
        x, a, b = x.select("block_id", F.zip_with("v", F.transform("r", lambda y: y * F.col("sign")), lambda p, q: p + q).alias("v")), 0.6, 0.4
    else:
        raise ValueError(method)
    mean = vectors.vector_sum(x, ["block_id"], "v", mean=True, name="m")
    y = own.join(mean, "block_id", "left")
    return y.select("block_id", vectors.unit(F.zip_with("e", F.coalesce("m", zero), lambda p, q: p * a + q * b)).alias("vector"))


def intents(walked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, block_id, confidence, rank, label of the k most likely nodes, ties by id.

    The label is three keywords, or the beginning of the summary, or the id; nodes that are no block have
    an unknown intent.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("p", 12)), "node")
    x = walked.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    x = x.join(blocks.select(F.col("block_id").alias("node"), "keywords", "summary"), "node", "left")
    label = F.when(F.col("keywords").isNull() & F.col("summary").isNull(), "unknown-intent").when(F.size("keywords") > 0, F.array_join(F.slice("keywords", 1, 3), "/"))
    label = label.when(F.coalesce("summary", F.lit("")) != "", F.left("summary", F.lit(24))).otherwise(F.col("node"))
    return x.select("query_id", F.col("node").alias("block_id"), F.col("p").alias("confidence"), "rank", label.alias("label"))


def predict(seeds: DataFrame, blocks: DataFrame, edges: DataFrame, cfg: Config = DEFAULT, method: str = "mean") -> dict[str, DataFrame]:
    """intents (with active, whether the best one is likely enough) and vectors (query_id, vector) of seeds (query_id, node)."""
    s = seeds.join(blocks.select(F.col("block_id").alias("node")), "node", "left_semi")
    walked = walk(s, edges, cfg.prediction_walk_depth, cfg.prediction_transition_decay)
    found = intents(walked, blocks, cfg.prediction_top_k)
    top = F.max("confidence").over(Window.partitionBy("query_id"))
    active = F.lit(True) if cfg.prediction_force_active_trigger else top >= cfg.prediction_active_threshold
    # Only nodes that a walk reached are embedded.
    reached = walked.select(F.col("node").alias("block_id")).distinct()
    x = walked.join(embed_nodes(blocks, edges, method, reached).withColumnRenamed("block_id", "node"), "node")
    summed = vectors.vector_sum(x, ["query_id"], "vector", F.col("p"))
    return {"intents": found.withColumn("active", active), "vectors": summed.select("query_id", vectors.unit(F.col("vector")).alias("vector"))}
