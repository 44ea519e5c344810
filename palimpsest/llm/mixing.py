"""Mixing sources to target weights by cube-method balanced sampling.

A source's rate is its target over its size; each document gets floor(rate) copies, and one more with
probability rate - floor(rate).  The flight phase moves these probabilities along the null-space of the
balancing constraints (document count and words), three documents at a time, until all but two of a block
are 0 or 1.  What is left of a source's blocks flies again, block of blocks by block of blocks, and only
the last one or two documents of a source land by rounding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORDS, numbered, renamed, saved, small_or_plain

#: Documents of a block in the first flight, and blocks whose left-overs meet in the next.
BLOCK, MERGE = 1000, 400


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of sizes (source, source_size): one row a source.

    Sources by code point, null last, take the weights in turn; all targets sum to share times all sizes,
    and no target exceeds most times its source's size: targets are least(cap, level * weight), the fixed
    point of sharing every excess out again by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    rows = rows.withColumn("level", (total - full) / rest)
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(Window.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, random: np.random.Generator) -> None:
    """Moves p in place until at most two lie strictly between 0 and 1; keeps sum(p) and sum(p * size) meanwhile."""
    hand: list[int] = []
    queue = iter(range(len(p)))
    eps = 1e-9
    while True:
        while len(hand) < 3 and (i := next(queue, None)) is not None:
            if eps < p[i] < 1 - eps:
                hand.append(i)
            else:
                p[i] = round(p[i])
        if len(hand) < 3:
            break
        a, b, c = hand
        u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        u /= np.abs(u).max()
        x, moved = p[hand], u != 0
        up = np.where(u > 0, 1 - x, x)[moved] / np.abs(u[moved])
        down = np.where(u > 0, x, 1 - x)[moved] / np.abs(u[moved])
        up, down = up.min(), down.min()
        x = x + u * (up if random.random() < down / (up + down) else -down)
        x = np.where(x < eps, 0.0, np.where(x > 1 - eps, 1.0, x))
        p[hand] = x
        hand = [i for i, v in zip(hand, x, strict=True) if 0 < v < 1]


def land(p: np.ndarray, size: np.ndarray) -> None:
    """Rounds what is left (two at most after a flight) to the subset nearest the expected words."""
    left = np.flatnonzero((p > 0) & (p < 1))
    want = float((p[left] * size[left]).sum())
    picks = [[m >> j & 1 for j in range(len(left))] for m in range(1 << len(left))]
    p[left] = min(picks, key=lambda m: (abs(float((np.array(m) * size[left]).sum()) - want), abs(sum(m) - float(p[left].sum()))))


def _flight(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "_id", "_size"], ignore_index=True)
        p, size = pdf["_p"].to_numpy(float).copy(), pdf["_size"].to_numpy(float)
        fly(p, size, np.random.default_rng([seed, int(pdf["_block"].iloc[0]), int(pdf["_order"].iloc[0]) & 0xFFFFFFFF]))
        if last:
            land(p, size)
        return pdf.assign(_p=p)

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, seed: int = 1) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken = copies * size.

    size is the number of words (null text: 0).  Null is a source of its own.  Rows of size 0 take part in
    the document count.  Repeated rows are sampled each for itself.  An empty table gives an empty mix.  Runs agree: the order within a source
    and all draws follow from ids, sizes and seed.
    """
    rows = renamed(docs, id_col, text_col, source_col).select(F.col("_id").cast("long"), F.col(f"_{source_col}").alias("source"), F.coalesce(F.regexp_count("_text", F.lit(WORDS)), F.lit(0)).cast("long").alias("_size"))
    rows = saved(rows)
    per = saved(rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_docs")))
    goal = saved(targets(per.select("source", "source_size"), weights, share).join(per.select(F.col("source").alias("_s"), "_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    most = goal.agg(F.max("_docs")).first()[0] or 0
    goal = goal.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "_s")
    x = rows.join(small_or_plain(goal), F.col("source").eqNullSafe(F.col("_s")))
    mixed = F.xxhash64("_id", "_size", F.lit(seed))
    x = x.select(
        "_id", F.col("_s"), "_size", "source_size", "target", F.floor("_rate").alias("_base"), (F.col("_rate") - F.floor("_rate")).alias("_p"),
        mixed.alias("_order"), F.pmod(mixed, F.ceil(F.col("_docs") / BLOCK)).alias("_block"),
    )
    schema, levels = x.schema, max(1, math.ceil(math.log(max(1, most / BLOCK), MERGE)) + 1)
    done = None
    for level in range(levels):
        last = level == levels - 1
        x = saved(x.groupBy("_s", "_block").applyInPandas(_flight(seed, last), schema))
        settled = x.filter("_p <= 0 or _p >= 1")
        done = settled if done is None else done.union(settled)
        x = x.filter("_p > 0 and _p < 1").withColumn("_block", F.floor(F.col("_block") / MERGE) if level < levels - 2 else F.lit(0).cast("long"))
    copies = (F.col("_base") + F.round("_p")).cast("long")
    return done.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the input's rows and columns, each as often as the mix takes it."""
    plan = saved(mix(docs, id_col, text_col, source_col, **how))
    plan = plan.groupBy(F.col(id_col).alias("_id"), F.col("size").alias("_size")).agg(F.array_sort(F.collect_list("copies")).alias("_copies"))
    plain, name = numbered(docs)
    n = F.coalesce(F.regexp_count(F.col(name[text_col]), F.lit(WORDS)), F.lit(0)).cast("long")
    x = plain.join(plan, F.col(name[id_col]).eqNullSafe(F.col("_id")) & (n == F.col("_size")))
    # Rows that share id and size are told apart by their order among themselves.
    alike = plan.filter(F.size("_copies") > 1).limit(1).count() > 0
    at = F.row_number().over(Window.partitionBy("_id", "_size").orderBy(*name.values())) if alike else F.lit(1)
    x = x.withColumn("_k", F.element_at("_copies", at)).filter("_k > 0")
    return x.select(*name.values(), F.explode(F.sequence(F.lit(1), F.col("_k").cast("int")))).select(*name.values()).toDF(*docs.columns)
