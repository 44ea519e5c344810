"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments.  Two fingerprints that differ in at most two bits have one
segment in which they differ in at most one; each segment is indexed under its 32 one-wildcard variants,
equal keys are candidates, and the whole fingerprints are compared.  Equal fingerprints are one node.

Keys are dealt out by range of (key, fingerprint), so a key that many fingerprints share spreads over
tasks.  A run that touches a task's edge, or that is longer than run_limit, goes another exact way: 120
variants of the whole fingerprint with 2 of 16 nibbles left out, under which at most 256 can be equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.shipping import ship

from .components import connected_components
from .shared import freed, in_small_batches, numbered, renamed, saved, small_or_plain

RADIUS = 2
RUN_LIMIT = 4096
PIECE = 100_000


def simhash(data: bytes | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a text in UTF-8; 0 if it has no word."""
    import xxhash

    words = (data or b"").lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        part = words[at : min(n, at + PIECE) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """_id, _h (hash of the text), fp (the fingerprint's bits as a signed long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(x.as_py(), shingle) for x in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], ["_id", "_h", "fp"])

    rows = renamed(docs, id_col, text_col).select(F.col("_id").cast("long"), F.col("_text").cast("binary"), F.xxhash64(F.col("_text").cast("binary")).alias("_h"))
    return rows.mapInArrow(run, "_id long, _h long, fp long")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits.  Unsigned, as the count of a negative number is that of its absolute value."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints: the index of the least member of each one's component under the radius."""
    label = np.arange(len(fps), dtype=np.int32)
    step = max(1, 250_000 // len(fps))
    while True:
        new = label.copy()
        for at in range(0, len(fps), step):
            near = apart(fps[at : at + step, None], fps[None, :]) <= radius
            new[at : at + step] = np.where(near, label[None, :], np.int32(len(fps))).min(axis=1)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _runs(edges_too: bool, radius: int, limit: int):
    """Over rows (t, k, fp) sorted within the task: links (a, b) inside equal (t, k); b null: fp goes the other way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, k, fp, long_run, first = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), False, True

        def out(a: list[np.ndarray], b: list[np.ndarray], other: list[np.ndarray]):
            a, b, other = (np.unique(np.concatenate(x)) if i == 2 and x else np.concatenate(x) if x else np.empty(0, np.int64) for i, x in enumerate((a, b, other)))
            if len(a) + len(other):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, other])), pa.concat_arrays([pa.array(b), pa.nulls(len(other), pa.int64())])], ["a", "b"])

        def settle(t, k, fp, ends):
            """Whole runs ending before each of ends."""
            nonlocal first, long_run
            a, b, other, at = [], [], [], np.concatenate([[0], ends])
            size = np.diff(at)
            skip = np.zeros(len(size), bool)
            if len(size) and (long_run or (first and edges_too)):
                other.append(fp[: at[1]])
                skip[0] = True
            first = first and not len(size)
            if len(size):
                long_run = False
            two = at[:-1][(size == 2) & ~skip]
            near = apart(fp[two], fp[two + 1]) <= radius
            a.append(fp[two][near])
            b.append(fp[two + 1][near])
            for i in np.flatnonzero((size > 2) & ~skip):
                own = fp[at[i] : at[i + 1]]
                if len(own) > limit:
                    other.append(own)
                    continue
                label = linked(own, radius)
                there = label != np.arange(len(own))
                a.append(own[there])
                b.append(own[label[there]])
            return out(a, b, other)

        for batch in batches:
            t, k, fp = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((t, k, fp)))
            ends = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            if len(ends):
                yield from settle(t, k, fp, ends)
                t, k, fp = (x[ends[-1] :].copy() for x in (t, k, fp))
            if len(fp) > limit:  # a run that goes on: its members go the other way; one stays to know its key
                yield from out([], [], [fp])
                t, k, fp, long_run = t[-1:].copy(), k[-1:].copy(), fp[-1:].copy(), True
        if len(fp):
            if edges_too:
                yield from out([], [], [fp])
            else:
                yield from settle(t, k, fp, np.array([len(fp)]))

    return run


def links(nodes: DataFrame, radius: int = RADIUS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """(a, b) over distinct fingerprints (fp): pairs that differ in at most two bits, or a path of such pairs for each."""
    if radius != RADIUS:
        raise ValueError("two segments with one wildcard cover a radius of 2")
    ship(nodes.sparkSession)
    parts = (F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    keys = F.explode(F.array(*[F.struct(F.lit(32 * s + i).alias("t"), part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).alias("k")) for s, part in enumerate(parts) for i in range(32)]))
    # Few bytes make many rows here, so the fingerprints are spread first.
    spread = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    rows = spread.select(keys.alias("v"), "fp").select("v.t", "v.k", "fp")
    found = saved(rows.repartitionByRange("t", "k", "fp").sortWithinPartitions("t", "k", "fp").mapInArrow(_runs(True, radius, run_limit), "a long, b long"))
    other = found.filter("b is null").select(F.col("a").alias("fp")).distinct()

    def signed(x: int) -> int:
        return x - (1 << 64) if x >= 1 << 63 else x

    masks = [signed(((1 << 64) - 1) ^ (15 << 4 * i) ^ (15 << 4 * j)) for i, j in combinations(range(16), 2)]
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for n, m in enumerate(masks)]))
    rows = other.select(keys.alias("v"), "fp").select("v.t", "v.k", "fp")
    more = rows.repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(_runs(False, radius, 256), "a long, b long")
    return found.filter("b is not null").union(more)


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, run_limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _h, fp), and of each fp: component_id, and first, the component's least (no id, id, text hash)."""
    prints = saved(fingerprints(docs, id_col, text_col, shingle))
    nodes = saved(prints.groupBy("fp").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_h")).alias("first")))
    roots = connected_components(links(nodes.select("fp"), radius, run_limit)).select(F.col("node").alias("fp"), "root")
    nodes = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    nodes = saved(nodes)
    groups = saved(nodes.groupBy("root").agg(F.min("first").alias("first")))
    return prints, saved(nodes.drop("first").join(groups, "root").select("fp", F.col("first._id").alias("component_id"), "first"))


@freed
@in_small_batches
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """One row per input row: id, fingerprint (16 lower-case hex digits), component_id.

    Null and wordless texts have fingerprint zero and are linked like any other.  component_id is the
    smallest id in the component (null only if all its ids are null); repeated rows share it.  Texts of any
    length are read to their end; an empty table gives an empty result.
    """
    prints, names = _components(docs, id_col, text_col, shingle, radius, run_limit)
    return prints.join(names, "fp").select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@freed
@in_small_batches
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns; of each component one document stays.

    It is the one of the smallest id (nulls last), and among different texts of that id the one of the
    smallest hash.  A document is an id with a text: its repeated rows stay or go together, and other texts
    under the same id are judged by their own component.
    """
    prints, names = _components(docs, id_col, text_col, 3, RADIUS, RUN_LIMIT)
    stays = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_h") == F.col("first._h"))
    gone = saved(prints.join(names, "fp").filter(~stays).select("_id", F.col("_h").alias("_g")).distinct())
    plain, name = numbered(docs)
    on = F.col(name[id_col]).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(name[text_col]).cast("binary")) == F.col("_g"))
    return plain.join(small_or_plain(gone), on, "left_anti").toDF(*docs.columns)
