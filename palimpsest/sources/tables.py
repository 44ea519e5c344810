"""The table layer: schemas, upserts, lookups that keep the caller's order, edge and raw-event stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.storage import durable

EVENT = "struct<event_id: string, role: string, text: string, ts_ms: bigint>"
SCHEMAS = {
    "events": "session_id bigint, seq bigint, role string, text string, ts_ms bigint",
    "blocks": f"session_id bigint, block_seq bigint, block_id string, start_ms bigint, end_ms bigint, token_count bigint, summary string, keywords array<string>, embedding array<double>, raw_events array<{EVENT}>, retention_mode string, match_score double, conflict boolean, tags array<string>",
    "raw_events": f"block_id string, events array<{EVENT}>, updated_ms bigint",
    "relations": "src string, dst string, type string, ts_ms bigint, confidence double",
    "snapshots": "snapshot_id string, file_id string, path string, version_key string, near_dup_key string, content_hash string, size bigint, modified_ms bigint, ts_ms bigint",
    "accesses": "snapshot_id string, file_id string, bytes_read bigint, truncated boolean, ts_ms bigint",
    "vectors": "snapshot_id string, embedding array<double>, ts_ms bigint",
}
#: Folders of a kept table.
BUCKETS = 64
KEYS = {"events": ["session_id", "seq"], "blocks": ["block_id"], "raw_events": ["block_id"], "relations": ["src", "dst", "type"], "snapshots": ["snapshot_id"], "vectors": ["snapshot_id"]}


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest order for each key: last write wins.  Empty strings are keys like any other."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The table with rows of equal keys replaced, and other rows added."""
    changes = latest(changes, keys, order) if order else changes
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes.select(*table.columns))


def remove(table: DataFrame, ids: DataFrame, key: str = "block_id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def get_many(blocks: DataFrame, ids: DataFrame, key: str = "block_id", place: str = "ord") -> DataFrame:
    """Blocks for (key, place) rows, in the caller's order with its repeats; unknown ids are left out."""
    return ids.join(blocks, key).orderBy(place)


def block_ids(raw: DataFrame) -> DataFrame:
    return raw.select("block_id").distinct()


def latest_edges(relations: DataFrame, order: str = "write_seq") -> DataFrame:
    return latest(relations, KEYS["relations"], order)


def outgoing(edges: DataFrame, src: str) -> DataFrame:
    return edges.filter(F.col("src") == src).orderBy(F.desc("ts_ms"), "dst", "type")


def incoming(edges: DataFrame, dst: str) -> DataFrame:
    return edges.filter(F.col("dst") == dst).orderBy(F.desc("ts_ms"), "src", "type")


def all_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("ts_ms", "src", "dst", "type")


def loaded_edges(rows: DataFrame) -> DataFrame:
    """Valid edges of a file: a type, an endpoint at least, no null; the highest confidence of each key."""
    ok = rows.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("type").isNotNull() & (F.col("type") != "") & ((F.col("src") != "") | (F.col("dst") != "")))
    keys = KEYS["relations"]
    best = ok.groupBy(*keys).agg(F.max(F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), "confidence", "ts_ms")).alias("_r"))
    return best.select(*keys, "_r.ts_ms", "_r.confidence")


def save(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    """Blocks and raw events by session if they have one; clustered in files by their keys for pruning."""
    keys = [k for k in KEYS.get(name, []) if k in df.columns]
    out = df.repartition(*keys).sortWithinPartitions(*keys) if keys else df
    out.write.mode(mode).parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A saved table with its fixed schema; empty if it was never written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], SCHEMAS[name])


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def load_kept(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that upsert_kept keeps, with its bucket; empty if it was never written."""
    from pyspark.errors import AnalysisException

    schema = f"{SCHEMAS[name]}, bucket int"
    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def upsert_kept(spark: SparkSession, path: str, name: str, changes: DataFrame, keys: list[str] | None = None, gone: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """Upserts a kept table, dealt to folders by hash of its keys; reads and rewrites the changed keys' folders only, and gives their numbers.

    Rows of a key that changes has are replaced by all of its rows for that key; rows of keys in gone go.  The
    keys and the number of buckets must stay the same while a table is kept.  Running it again changes nothing.
    """
    keys, names = keys or KEYS[name], [f.name for f in load_kept(spark, path, name).schema.fields]
    bucket = bucket_of(keys, buckets)
    changes = durable(changes.withColumn("bucket", bucket).select(*names))
    drop = changes.select(*keys).distinct()
    if gone is not None:  # joined, as Spark 4.1 can't plan the union of two saved tables of which it knows constraints of columns left out
        drop = drop.join(gone.select(*keys).distinct(), keys, "full")
    drop = durable(drop.withColumn("bucket", bucket))
    touched = sorted(r.bucket for r in drop.select("bucket").distinct().collect())  # buckets numbers at most
    if not touched:
        return []
    held = load_kept(spark, path, name).filter(F.col("bucket").isin(touched))
    merged = durable(held.join(drop.select(*keys), keys, "left_anti").select(*names).unionByName(changes))
    merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")
    left = {r.bucket for r in merged.select("bucket").distinct().collect()}
    for b in touched:
        if b not in left:  # a folder that nothing is written to would stay as it was
            merged.limit(0).drop("bucket").write.mode("overwrite").parquet(f"{path}/{name}/bucket={b}")
    return touched


def newest(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group, oldest first."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n").orderBy(*by, order)
