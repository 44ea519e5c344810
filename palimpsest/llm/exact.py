"""Exact deduplication by progressive refinement: length, then hash of a prefix, then full hash.

Built-in functions only.  The first pass makes a narrow table (id, length, prefix hash).  A row whose
length, or whose length and prefix, no other row has is settled; the full hash decides among the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, numbered, renamed, saved, small_or_plain


def normalised(text: Column) -> Column:
    """Without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def surviving_keys(rows: DataFrame) -> DataFrame:
    """(_len, _head) that more than one row has, found by length first.  rows: _len, _head."""
    lengths = saved(rows.groupBy("_len").count().filter("count > 1").select("_len"))
    return rows.join(small_or_plain(lengths), "_len", "left_semi").groupBy("_len", "_head").count().filter("count > 1").select("_len", "_head")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (null: settled before the full hash).

    Of equal texts the row with the most code points stays, then the smallest id (null ids last).  Null
    text counts as empty.  Rows that repeat both id and text are one name for one document: each carries
    the same keep_id and kept, and group_size counts all of them.  An empty table gives an empty result.
    """
    return _grouped(_hashed(docs, id_col, text_col, prefix), id_col)


def _hashed(docs: DataFrame, id_col: str, text_col: str, prefix: int, every: bool = False) -> DataFrame:
    """_id, _chars, _full, _open.  every: also hash the rows that are already settled."""
    rows = renamed(docs, id_col, text_col).select("_id", F.xxhash64("_text").alias("_row"), F.coalesce(F.char_length("_text"), F.lit(0)).alias("_chars"), normalised(F.col("_text")).alias("_norm"))
    rows = rows.select("*", F.octet_length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix)).alias("_head"))
    keys = saved(surviving_keys(saved(rows.select("_len", "_head")))).withColumn("_open", F.lit(True))
    rows = rows.join(small_or_plain(keys), ["_len", "_head"], "left")
    full = F.sha2("_norm", 256)
    return rows.select("_id", "_row", "_chars", F.coalesce("_open", F.lit(False)).alias("_open"), (full if every else F.when(F.col("_open"), full)).alias("_full"))


def _judged(hashed: DataFrame) -> DataFrame:
    """_id, _row, _full, _size, _keep of every row."""
    rows = saved(hashed)
    best = F.max(F.struct("_chars", F.bitwise_not("_id").alias("_last"), "_id"))
    groups = rows.filter("_open").groupBy("_full").agg(F.count("*").alias("_size"), best.alias("_best")).filter("_size > 1")
    groups = groups.select("_full", "_size", F.col("_best._id").alias("_keep"), F.lit(True).alias("_in"))
    # Saved, so that a join with both sides freshly dealt out can split a hot group.
    out = rows.join(small_or_plain(saved(groups)), "_full", "left")
    return out.select("_id", "_row", "_full", F.coalesce("_size", F.lit(1)).cast("long").alias("_size"), F.when(F.col("_in"), F.col("_keep")).otherwise(F.col("_id")).alias("_keep"))


def _grouped(hashed: DataFrame, id_col: str) -> DataFrame:
    kept = F.col("_keep").eqNullSafe(F.col("_id"))
    return _judged(hashed).select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), kept.alias("kept"), F.col("_full").alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """As exact_duplicates, with the full hash of every row as a digest column."""
    return _grouped(_hashed(docs, id_col, text_col, prefix, every=True), id_col)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without those that an equal text replaces; which stays is as in exact_duplicates.

    Only rows whose length and prefix another row shares are hashed in full.  A row that goes is found again
    by its id and a hash of its text as it is, so another text of the same id stays; repeated rows of one id
    and text stay or go together.
    """
    gone = saved(_judged(_hashed(docs, id_col, text_col, 64)).filter(~F.col("_keep").eqNullSafe(F.col("_id"))).select("_id", "_row").distinct())
    plain, name = numbered(docs)
    on = F.col(name[id_col]).eqNullSafe(F.col("_id")) & (F.xxhash64(name[text_col]) == F.col("_row"))
    return plain.join(small_or_plain(gone), on, "left_anti").toDF(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
h AS (SELECT doc_id, n, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = doc_id AS kept, text_sha256
FROM h"""
