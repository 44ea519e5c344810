"""Files: listing, bounded reads, writes, and the sinks that record what was read."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vectors


def confined(root: str, path: str) -> str:
    """The path inside the root; ValueError if it leads out of it."""
    full = os.path.normpath(os.path.join(root, path))
    if full != os.path.normpath(root) and not full.startswith(os.path.normpath(root) + os.sep):
        raise ValueError(f"{path!r} is outside of the root")
    return full


def listing(spark: SparkSession, root: str, path: str = ".", limit: int = 200) -> DataFrame:
    """name, kind, size, modified_ms of a folder: folders first, then by name; limit within 1 and 2000."""
    jvm, full = spark._jvm, confined(root, path)
    at = jvm.org.apache.hadoop.fs.Path(full)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    rows = [(s.getPath().getName(), "directory" if s.isDirectory() else "file", s.getLen(), s.getModificationTime()) for s in found]
    df = spark.createDataFrame(rows, "name string, kind string, size long, modified_ms long")
    return df.orderBy(F.col("kind") != "directory", "name").limit(min(2000, max(1, limit)))


def read_files(spark: SparkSession, root: str, path: str, max_bytes: int = 65_536) -> DataFrame:
    """path, size, bytes_read, truncated, modified_ms, text: a prefix of every file, bounded in bytes."""
    x = spark.read.format("binaryFile").load(confined(root, path))
    return x.select(
        "path", F.col("length").alias("size"), F.least("length", F.lit(max_bytes)).alias("bytes_read"), (F.col("length") > max_bytes).alias("truncated"),
        F.unix_millis("modificationTime").alias("modified_ms"), F.decode(F.substring("content", 1, max_bytes), "UTF-8").alias("text"),
    )


def write_text(df: DataFrame, root: str, path: str, append: bool = False, max_bytes: int = 262_144) -> None:
    """One string column as lines; ValueError over the byte cap."""
    column = df.columns[0]
    size = df.agg(F.sum(F.octet_length(column) + 1)).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"{size} bytes are over the cap of {max_bytes}")
    df.select(F.col(column).alias("value")).write.mode("append" if append else "overwrite").text(confined(root, path))


def access_tables(reads: DataFrame, ts_ms: int = 0) -> dict[str, DataFrame]:
    """snapshots, accesses and vectors of files read (as read_files gives them)."""
    x = reads.withColumn("file_id", F.concat(F.lit("file:"), "path")).withColumn("version_key", T.version_key("text")).withColumn("near_dup_key", T.near_dup_key("text"))
    x = x.withColumn("snapshot_id", F.concat(F.lit("snapshot:"), "path", F.lit("#"), "version_key")).withColumn("content_hash", F.sha2("text", 256))
    return {
        "snapshots": x.select("snapshot_id", "file_id", "path", "version_key", "near_dup_key", "content_hash", "size", "modified_ms", F.lit(ts_ms).cast("long").alias("ts_ms")),
        "accesses": x.select("snapshot_id", "file_id", "bytes_read", "truncated", F.lit(ts_ms).cast("long").alias("ts_ms")),
        "vectors": x.select("snapshot_id", vectors.file_vector("text").alias("embedding"), F.lit(ts_ms).cast("long").alias("ts_ms")),
    }


def record_access(reads: DataFrame, path: str, ts_ms: int = 0, sink: str = "parquet") -> None:
    """Writes the three tables; sink "noop" discards them."""
    for name, table in access_tables(reads, ts_ms).items():
        writer = table.write.mode("append")
        writer.format("noop").mode("overwrite").save() if sink == "noop" else writer.parquet(f"{path}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(value, path: str) -> None:
    """A small JSON file on the driver's disk, by a temporary file and a rename."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(path + ".tmp", path)


def trace_tail(trace: DataFrame, n: int, max_entries: int = 1000) -> DataFrame:
    """The last n of the newest max_entries rows (id grows), oldest first."""
    kept = trace.orderBy(F.desc("id")).limit(max_entries)
    return kept.orderBy(F.desc("id")).limit(n).orderBy("id")
