"""Hard-negative mining by blocked dense products.

Anchor blocks are broadcast against candidate blocks, in slices of a bounded size.  A first pass keeps each
anchor's best rows of its label, mergeable over tasks; a second one keeps, for each anchor and positive, the
best rows of other labels within the positive's window.
Components are whole numbers in float64, so products are exact below 2^53 in whatever order they are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.tiles import Best, best_pairs, entries, matrix, packed, paired, product, values

from .shared import in_small_batches, saved

#: Rows of an anchor block and of a candidate block; scores of a pair of blocks that a task aims at.
ANCHORS, CANDIDATES, TASK_CELLS = 512, 4000, 4_000_000_000


def whole_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id long, label long, v array<double>: rows that take part, components as floor(256 x).

    Ids and labels are whole numbers.  Out are rows with a null label or id, a null vector, or a component that is null, infinite or no number.
    """
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    x = x.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    return x.withColumn("v", F.transform("v", lambda c: F.floor(256 * c).cast("double")))


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows and anchors (id, label, v of whole numbers).

    Positives are an anchor's first n_positives rows of its label and another id; negatives of a positive the
    first n_negatives rows of another label with low * positive <= 100 * negative <= high * positive.  Higher
    scores come first, ties by smaller id.  Every row counts: repeated candidates each take a place, repeated
    anchors each have their result.  Missing components of a shorter vector count as zeros.  An anchor without a
    positive, or whose windows are empty, has no row; empty tables give none.
    """
    anchors = saved(anchors.select("id", "label", "v").withColumn("anchor", F.monotonically_increasing_id()))
    n_rows, n_anchors = rows.count(), anchors.count()
    tasks = min(20_000, -(-n_rows * n_anchors // TASK_CELLS))
    if tasks > rows.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(tasks)
    blocks = packed(rows.select("v", "id", "label"), "v", CANDIDATES)
    first = best_pairs(paired(saved(packed(anchors, "v", ANCHORS)), blocks), "anchor long, id long, score double", _same_label(n_positives), entries(["anchor", "id", "score"]))
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    positives = first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n_positives)
    found = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    asked = anchors.join(found, "anchor").withColumn("tops", F.to_json("p.score")).withColumn("names", F.to_json("p.id")).drop("p")
    asked = saved(packed(asked.select("v", "anchor", "id", "label", "tops", "names"), "v", ANCHORS))
    schema = "anchor long, anchor_id long, place int, positive_id long, positive_score double, negative_id long, negative_score double"
    second = best_pairs(paired(asked, blocks), schema, _in_window(n_positives, n_negatives, low, high), _negatives)
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = second.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", *[_long(c) for c in ("positive_score", "negative_score")])


def _long(score: str):
    """Whole numbers from float64; what a long can't hold becomes the nearest one that float64 has."""
    return F.greatest(F.least(score, F.lit(2.0**63 - 1024)), F.lit(-(2.0**63))).cast("long").alias(score)


def _candidates(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block by ascending id: vectors, ids, labels."""
    ids = values(b, i, "id")
    order = np.argsort(ids, kind="stable")
    return matrix(b, i)[order], ids[order], values(b, i, "label")[order]


def _same_label(k: int):
    def feed(b: pa.RecordBatch, i: int, state: dict) -> None:
        keys, own, labels, a = values(b, i, "l_anchor"), values(b, i, "l_id"), values(b, i, "l_label"), matrix(b, i, "l_")
        best, _ = state.setdefault(b.column("l_number")[i].as_py(), (Best(len(keys), k), keys))
        c, ids, other = _candidates(b, i)
        for label in np.intersect1d(labels, other):
            rows, cols = np.flatnonzero(labels == label), np.flatnonzero(other == label)
            best.add(rows, product(a[rows], c[cols]), own[rows, None] != ids[cols], ids[cols])

    return feed


def _in_window(n_positives: int, k: int, low: int, high: int):
    import json

    def bound(top: np.ndarray, share: int, up: bool) -> np.ndarray:
        """share * top / 100, rounded into the window: exact for whole numbers below 2^53."""
        exact = np.where(np.abs(top) < 2.0**53, top, 0).astype(np.int64) * share
        whole = (-(-exact // 100) if up else exact // 100).astype(float)
        return np.where(np.abs(top) < 2.0**53, whole, top * (share / 100))

    def feed(b: pa.RecordBatch, i: int, state: dict) -> None:
        keys, labels, a = values(b, i, "l_anchor"), values(b, i, "l_label"), matrix(b, i, "l_")
        number = b.column("l_number")[i].as_py()
        if number not in state:
            tops, names = np.full((len(keys), n_positives), np.nan), np.zeros((len(keys), n_positives), np.int64)
            for j, (top, name) in enumerate(zip(b.column("l_tops")[i].as_py(), b.column("l_names")[i].as_py(), strict=True)):
                top, name = json.loads(top), json.loads(name)
                tops[j, : len(top)], names[j, : len(name)] = top, name
            none = np.isnan(tops)
            most, least = bound(np.nan_to_num(tops), high, False), bound(np.nan_to_num(tops), low, True)
            most[none], least[none] = -np.inf, np.inf
            state[number] = Best(len(keys) * n_positives, k), (keys, values(b, i, "l_id"), tops, names, least, most)
        best, (_, _, _, _, least, most) = state[number]
        c, ids, other = _candidates(b, i)
        s = product(a, c)
        ok = (labels[:, None] != other) & (s >= least.min(axis=1)[:, None]) & (s <= most.max(axis=1)[:, None])
        some = np.flatnonzero(ok.any(axis=1))
        s, ok = s[some], ok[some]
        for j in range(n_positives if len(some) else 0):
            best.add(some * n_positives + j, s, ok & (s >= least[some, j, None]) & (s <= most[some, j, None]), ids)

    return feed


def _negatives(best: Best, more: tuple) -> pa.RecordBatch:
    keys, own, tops, names, _, _ = more
    row, slot = np.nonzero(best.score > -np.inf)
    a, place = np.divmod(row, tops.shape[1])
    columns = [keys[a], own[a], place.astype(np.int32), names[a, place], tops[a, place], best.id[row, slot], best.score[row, slot]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])


@in_small_batches
def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 100) -> DataFrame:
    """Hard negatives of all rows for the anchors, whose ids every divides; labels of ids divisible by 7 go one up, modulo 10."""
    x = whole_components(rows, id_col, vector_col, label_col)
    x = x.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(x, x.filter(F.col("id") % every == 0))


ORACLE = """WITH taken AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM taken a, taken b WHERE a.id % 100 = 0 AND (a.id <> b.id OR a.label <> b.label)),
pos AS (SELECT a, b, s FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b))::INTEGER AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM pos p JOIN pairs n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s QUALIFY rank <= 5"""
