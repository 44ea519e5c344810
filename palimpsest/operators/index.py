"""A kept keyword index: postings of each batch of blocks beside those of earlier batches, and removals.

Parquet tables below one folder, each partitioned by batch: members (block_id, hash of its content), postings
(also by part, a hash of the key, so that a lookup reads the parts of its keys), removed (block_id: what earlier
batches hold of it no longer counts), and batches (a row of counts).  A batch reads and writes its own blocks
only, and its counts last: without them it does not count, and the next run replaces it under the same number.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import retrieve
from palimpsest.storage import durable

PARTS = 64
SCHEMAS = {
    "members": "block_id string, hash string, batch int",
    "postings": "key string, indexed boolean, own boolean, block_id string, block_seq bigint, size int, batch int, part int",
    "removed": "block_id string, batch int",
    "batches": "new bigint, changed bigint, gone bigint, batch int",
}


def part_of(key: Column | str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def read(spark: SparkSession, at: str, name: str) -> DataFrame:
    """All rows that were ever written to one of the tables; none if there is no table yet."""
    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{at}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMAS[name])


def last_batch(spark: SparkSession, at: str) -> int:
    return read(spark, at, "batches").agg(F.max("batch")).first()[0] or 0


def live(spark: SparkSession, at: str, name: str) -> DataFrame:
    """The rows that count: of a whole batch, and no later one removed their block."""
    whole = F.col("batch") <= last_batch(spark, at)
    gone = read(spark, at, "removed").filter(whole).groupBy("block_id").agg(F.max("batch").alias("_gone"))
    x = read(spark, at, name).filter(whole).join(gone, "block_id", "left")
    return x.filter(F.col("_gone").isNull() | (F.col("batch") >= F.col("_gone"))).drop("_gone")


def changes(spark: SparkSession, at: str, blocks: DataFrame, whole: bool = False) -> DataFrame:
    """block_id, kind of blocks (block_id, hash) that are new, changed or, where blocks are all there are, gone."""
    held = live(spark, at, "members").select("block_id", F.col("hash").alias("_held"))
    x = blocks.select("block_id", "hash").join(held, "block_id", "full" if whole else "left")
    kind = F.when(F.col("hash").isNull(), "gone").when(F.col("_held").isNull(), "new").when(F.col("hash") != F.col("_held"), "changed")
    return x.select("block_id", "hash", kind.alias("kind")).filter("kind is not null")


def update(spark: SparkSession, at: str, blocks: DataFrame, whole: bool = False, removals: DataFrame | None = None, parts: int = PARTS) -> dict[str, int]:
    """Brings the index up to blocks (block_id, block_seq, hash, keywords; unique ids): counts of new, changed and gone ones.

    Blocks that the index holds with the same hash are passed over, and their keywords are not worked out.
    whole: blocks are all there are, and others leave the index; removals (block_id) leave it in any case.
    """
    todo = changes(spark, at, blocks, whole)
    if removals is not None:
        there = live(spark, at, "members").select("block_id").join(removals.select("block_id").distinct(), "block_id", "left_semi")
        there = there.select("block_id", F.lit(None).cast("string").alias("hash"), F.lit("gone").alias("kind"))
        todo = todo.join(removals.select("block_id").distinct(), "block_id", "left_anti").unionByName(there)
    todo = durable(todo)
    counts = {"new": 0, "changed": 0, "gone": 0} | {r.kind: r.n for r in todo.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not sum(counts.values()):
        return counts
    number = last_batch(spark, at) + 1
    folder = lambda name: f"{at}/{name}/batch={number}"
    fresh = todo.filter("hash is not null").select("block_id", "hash")
    rows = retrieve.postings(blocks.join(fresh, ["block_id", "hash"], "left_semi")).withColumn("part", part_of("key", parts))
    rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(folder("postings"))
    todo.filter("kind <> 'new'").select("block_id").write.mode("overwrite").parquet(folder("removed"))
    fresh.write.mode("overwrite").parquet(folder("members"))
    _close(spark, folder("batches"), counts)
    return counts


def _close(spark: SparkSession, folder: str, counts: dict[str, int]) -> None:
    row = spark.createDataFrame([tuple(counts[k] for k in ("new", "changed", "gone"))], "new bigint, changed bigint, gone bigint")
    row.coalesce(1).write.mode("overwrite").parquet(folder)


def scores(spark: SparkSession, at: str, queries: DataFrame, parts: int = PARTS) -> DataFrame:
    """retrieve.keyword_scores against the kept postings; only the parts that hold a key of the queries are read."""
    return retrieve.scored(queries, _asked(spark, at, queries, parts))


def topk(spark: SparkSession, at: str, queries: DataFrame, k: int, parts: int = PARTS, often: int = retrieve.OFTEN) -> DataFrame:
    """retrieve.keyword_topk against the kept postings; frequent keys are followed only where they can matter."""
    return retrieve.pruned_topk(queries, _asked(spark, at, queries, parts), k, often)


def _asked(spark: SparkSession, at: str, queries: DataFrame, parts: int) -> DataFrame:
    asked = retrieve.query_keys(queries).select(part_of("key", parts).alias("part")).distinct()
    wanted = [r.part for r in asked.collect()]  # parts numbers at most
    return live(spark, at, "postings").filter(F.col("part").isin(wanted))


def compacted(spark: SparkSession, at: str, to: str) -> None:
    """The rows that count, as the first batch of an index in a new folder."""
    postings = live(spark, at, "postings").drop("batch")
    postings.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{to}/postings/batch=1")
    members = live(spark, at, "members").select("block_id", "hash")
    members.write.mode("overwrite").parquet(f"{to}/members/batch=1")
    _close(spark, f"{to}/batches/batch=1", {"new": members.count(), "changed": 0, "gone": 0})
