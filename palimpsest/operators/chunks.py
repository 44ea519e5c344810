"""Chunk manifest: blocks of a session in time order become chunks; neighbours inside a chunk extend results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.shipping import ship
from palimpsest.sources.config import DEFAULT, Config


def continuous(a, b, least: float = 0.34) -> bool:
    x, y = {str(k).lower() for k in (a if a is not None else ())}, {str(k).lower() for k in (b if b is not None else ())}
    return bool(x) and bool(y) and len(x & y) / max(1, min(len(x), len(y))) >= least


def fold_chunks(batches: Iterator[pd.DataFrame], cfg: Config) -> Iterator[pd.DataFrame]:
    """Adds chunk_seq to blocks sorted by session and start; state is the open chunk's tokens, count, end and tail."""
    key, seq, tokens, count, end, tail = None, 0, 0, 0, 0, None
    for pdf in batches:
        out = []
        for session, start, stop, n, words in zip(pdf["session_id"], pdf["start_ms"], pdf["end_ms"], pdf["tokens"], pdf["keywords"], strict=True):
            if session != key or count == 0:
                key, seq, tokens, count, end, fresh = session, 0, 0, 0, stop, False
            else:
                gap = cfg.chunk_max_gap_ms > 0 and start - end > cfg.chunk_max_gap_ms
                full = (cfg.chunk_target_tokens > 0 and (tokens >= cfg.chunk_target_tokens or tokens + n > cfg.chunk_target_tokens)) or (cfg.chunk_max_tokens > 0 and tokens + n > cfg.chunk_max_tokens) or (cfg.chunk_max_blocks > 0 and count >= cfg.chunk_max_blocks)
                fresh = gap or (full and not continuous(tail, words))
            if fresh:
                seq, tokens, count, end = seq + 1, 0, 0, stop
            tokens, count, end, tail = tokens + n, count + 1, max(end, stop), words
            out.append(seq)
        yield pdf.assign(chunk_seq=pd.Series(out, index=pdf.index, dtype="int64"))


def positions(blocks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """session_id, block_id, chunk_seq, pos (in the chunk from 0), start_ms, end_ms, tokens, token_start."""
    ship(blocks.sparkSession)
    x = blocks.select("session_id", "block_id", "start_ms", "end_ms", F.greatest(F.lit(1).cast("long"), "token_count").alias("tokens"), "keywords")
    y = x.repartition("session_id").sortWithinPartitions("session_id", "start_ms", "block_id").mapInPandas(lambda it: fold_chunks(it, cfg), x.schema.add("chunk_seq", "long"))
    order = Window.partitionBy("session_id").orderBy("start_ms", "block_id")
    y = y.withColumn("token_start", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pos = F.row_number().over(Window.partitionBy("session_id", "chunk_seq").orderBy("start_ms", "block_id")) - 1
    return y.withColumn("pos", pos.cast("long")).drop("keywords")


def manifest(placed: DataFrame) -> DataFrame:
    """A row a chunk: id, blocks, times, token span and source hash."""
    e = F.struct("pos", "block_id")
    x = placed.groupBy("session_id", "chunk_seq").agg(
        F.transform(F.array_sort(F.collect_list(e)), lambda s: s["block_id"]).alias("block_ids"), F.min_by("start_ms", "pos").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.min("token_start").alias("token_start"), F.max(F.col("token_start") + F.col("tokens")).alias("token_end"),
    )
    x = x.withColumn("chunk_id", F.concat(F.lit("chunk-"), (F.col("chunk_seq") + 1).cast("string")))
    parts = F.concat_ws("|", "chunk_id", F.array_join("block_ids", ","), *[F.col(c).cast("string") for c in ("start_ms", "end_ms", "token_start", "token_end")])
    return x.withColumn("source_hash", F.left(F.sha1(parts), F.lit(16)))


def neighbors(placed: DataFrame, window: int) -> DataFrame:
    """block_id, other, distance, ord: chunk mates within the window, nearest first, the earlier before the later."""
    a = placed.select("session_id", "chunk_seq", "block_id", "pos")
    near = F.explode(F.filter(F.sequence(F.lit(-window), F.lit(window)), lambda d: d != 0))
    asked = a.select("session_id", "chunk_seq", "block_id", near.alias("d"), "pos").withColumn("pos", F.col("pos") + F.col("d"))
    x = asked.join(a.withColumnRenamed("block_id", "other"), ["session_id", "chunk_seq", "pos"])
    return x.select("block_id", "other", F.abs("d").alias("distance"), (2 * F.abs("d") + (F.col("d") > 0).cast("int")).alias("ord"))


def expanded(refs: DataFrame, scores: DataFrame, placed: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """refs (query_id, block_id, score, rank) and behind them chunk mates of those at or above the gate, a few at most.

    A mate's score is its own if it has one, else its seed's less 0.0001.
    """
    n = neighbors(placed, cfg.chunk_neighbor_window)
    x = refs.filter(F.col("score") >= cfg.chunk_neighbor_score_gate).join(n, "block_id").select("query_id", F.col("other").alias("block_id"), F.col("score").alias("seed"), "rank", "ord")
    x = x.join(refs.select("query_id", "block_id"), ["query_id", "block_id"], "left_anti")
    x = x.groupBy("query_id", "block_id").agg(F.min(F.struct("rank", "ord", "seed")).alias("b")).select("query_id", "block_id", "b.*")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "ord"))
    x = x.withColumn("p", place).filter(F.col("p") <= cfg.chunk_max_expanded_blocks)
    x = x.join(scores.select("query_id", "block_id", "score"), ["query_id", "block_id"], "left")
    last = refs.groupBy("query_id").agg(F.max("rank").alias("last"))
    more = x.join(last, "query_id").select("query_id", "block_id", F.coalesce("score", F.greatest(F.lit(0.0), F.col("seed") - 0.0001)).alias("score"), (F.col("last") + F.col("p")).alias("rank"))
    return refs.select("query_id", "block_id", "score", "rank").unionByName(more)
