"""Sealing: an ordered event stream becomes blocks, blocks are enriched.

The cut decision depends on what the open block holds, so it is a fold over each session in arrival order.
The fold streams over rows sorted by session and arrival in one shuffle; it keeps a few numbers a session,
whatever its length.  All else is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vectors, words
from palimpsest.shipping import ship
from palimpsest.sources.config import DEFAULT, Config
from palimpsest.storage import durable

_FINAL = re.compile(r"[。！？.!?][\"'」』]?$")


def monotone(ts: str = "ts_ms", by: str = "session_id", seq: str = "seq") -> Column:
    """max(ts, previous + 1) in arrival order, in closed form over the row number _n."""
    order = Window.partitionBy(by).orderBy(seq)
    high = F.max(F.col(ts) - F.col("_n")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return high + F.col("_n")


def with_monotone_time(events: DataFrame, now_ms: int = 0, by: str = "session_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy("seq")
    x = events.withColumn("_n", F.row_number().over(order)).withColumn("ts_ms", F.coalesce("ts_ms", F.lit(now_ms)))
    return x.withColumn("ts_ms", monotone(by=by)).drop("_n")


class Fold:
    """State of one session's open block, and the rules that close it."""

    def __init__(self, cfg: Config):
        self.cfg, self.tokens, self.block, self.last = cfg, 0, 0, None
        self.over = False

    def closes(self, role: str, text: str, ts: int, tokens: int) -> bool:
        """Whether the open block is sealed before this event is appended."""
        if self.last is None or self.over:
            return self.over
        cfg, (last_role, last_text, last_ts) = self.cfg, self.last
        if cfg.proactive_seal_enabled:
            if max(0, ts - last_ts) / 1000 >= cfg.proactive_seal_idle_seconds:
                return True
            if cfg.proactive_seal_turn_boundary and last_role != role and self.tokens >= max(cfg.proactive_seal_min_tokens, cfg.min_tokens_per_block):
                return True
        fixed = self.tokens > 0 and self.tokens + tokens > cfg.max_tokens_per_block
        if cfg.chunk_strategy == "fixed":
            return fixed
        meaning = self.boundary(role, text, tokens, last_role, last_text)
        return meaning if cfg.chunk_strategy == "semantic" else fixed or meaning

    def boundary(self, role: str, text: str, tokens: int, last_role: str, last_text: str) -> bool:
        most, now = self.cfg.max_tokens_per_block, self.tokens
        if now == 0:
            return False
        if now + tokens > most * 1.35:
            return True
        if now + tokens < most or now < self.cfg.min_tokens_per_block:
            return False
        before, after = last_text.rstrip(), text.lstrip()
        return last_role != role or bool(_FINAL.search(before)) or "\n\n" in before or "\n\n" in after or after.lower().startswith(words.TOPIC_PREFIXES)

    def add(self, role: str, text: str, ts: int, tokens: int) -> int:
        """The number of the block that the event joins."""
        if self.closes(role, text, ts, tokens):
            self.block, self.tokens = self.block + 1, 0
        self.over = False
        self.tokens += tokens
        self.last = (role, text, ts)
        # Over the hard limit the block is sealed with this event in it.
        self.over = self.tokens >= int(self.cfg.max_tokens_per_block * 1.5)
        return self.block


def fold_rows(batches: Iterator[pd.DataFrame], cfg: Config) -> Iterator[pd.DataFrame]:
    """Adds block_seq to rows sorted by session and arrival; seal_after forces a cut behind a row."""
    key, fold = None, None
    for pdf in batches:
        out = []
        for session, role, text, ts, tokens, seal in zip(pdf["session_id"], pdf["role"], pdf["text"], pdf["ts_ms"], pdf["tokens"], pdf["seal_after"], strict=True):
            if fold is None or session != key:
                key, fold = session, Fold(cfg)
            out.append(fold.add(role, text or "", ts, tokens))
            fold.over = fold.over or bool(seal)
        yield pdf.assign(block_seq=pd.Series(out, index=pdf.index, dtype="int64"))


def assign_blocks(events: DataFrame, cfg: Config = DEFAULT, seal_every: int | None = None) -> DataFrame:
    """events (session_id, seq, role, text, ts_ms) with tokens, times made monotone, and block_seq from 0.

    seal_every also cuts behind every so manieth event of a session.
    """
    ship(events.sparkSession)
    x = with_monotone_time(events.select("session_id", "seq", "role", F.coalesce("text", F.lit("")).alias("text"), "ts_ms"))
    x = x.withColumn("tokens", T.estimate_tokens("text"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    x = x.withColumn("seal_after", (place % seal_every == 0) if seal_every else F.lit(False))
    schema = x.schema.add("block_seq", "long")
    return x.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(lambda it: fold_rows(it, cfg), schema).drop("seal_after")


def block_id(session: Column, seq: Column) -> Column:
    return F.format_string("block_%010d_%06d", session.cast("long"), seq.cast("long"))


def to_blocks(assigned: DataFrame) -> DataFrame:
    """One row a block: times, tokens and its events in order."""
    event = F.struct("seq", F.concat_ws("#", F.col("session_id").cast("string"), F.col("seq").cast("string")).alias("event_id"), "role", "text", "ts_ms")
    x = assigned.groupBy("session_id", "block_seq").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.sum("tokens").alias("token_count"), F.array_sort(F.collect_list(event)).alias("_e"))
    return x.select("session_id", "block_seq", block_id(F.col("session_id"), F.col("block_seq")).alias("block_id"), "start_ms", "end_ms", "token_count", F.transform("_e", lambda e: e.dropFields("seq")).alias("raw_events"))


def event_text(events: Column | str) -> Column:
    e = F.col(events) if isinstance(events, str) else events
    return F.array_join(F.transform(e, lambda x: x["text"]), " ")


def enrich(blocks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Summary, then keywords, tags and embedding of summary and events."""
    x = blocks.withColumn("summary", T.summary("raw_events"))
    x = x if x.isStreaming else durable(x)  # so a task has one Python worker at a time
    x = x.withColumn("_text", F.concat_ws(" ", "summary", event_text("raw_events")))
    x = x.withColumn("keywords", T.keywords("_text", 8)).withColumn("tags", F.array(T.tag(F.col("_text"), cfg.important_threshold)))
    return x.withColumn("embedding", vectors.hash_embedding("_text", cfg.embedding_dim, cfg.embedding_seed)).drop("_text")


def apply_retention(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, raw events): every block's events are stored; compressed blocks lose their own copy."""
    raw = blocks.select("block_id", F.col("raw_events").alias("events"), F.col("end_ms").alias("updated_ms"))
    empty = F.array().cast(blocks.schema["raw_events"].dataType)
    return blocks.withColumn("raw_events", F.when(F.col("retention_mode") == "compressed", empty).otherwise(F.col("raw_events"))), raw


def idle_sessions(events: DataFrame, by: str, ts: str, idle_seconds: int = 300) -> DataFrame:
    """Sessions by idle gap alone, in built-in windows: a gap of idle_seconds or more starts a new one."""
    order = Window.partitionBy(by).orderBy(ts)
    gap = F.unix_millis(F.col(ts).cast("timestamp")) - F.unix_millis(F.lag(ts).over(order).cast("timestamp"))
    x = events.withColumn("_new", F.when(gap >= idle_seconds * 1000, 1).otherwise(0))
    x = x.withColumn("session", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.groupBy(by, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def follows(blocks: DataFrame) -> DataFrame:
    """FOLLOWS edges of confidence 1 from each block to the next of its session."""
    before = F.lag("block_id").over(Window.partitionBy("session_id").orderBy("block_seq"))
    x = blocks.select("session_id", before.alias("src"), F.col("block_id").alias("dst"), F.col("end_ms").alias("ts_ms"))
    return x.filter("src is not null").select("src", "dst", F.lit("FOLLOWS").alias("type"), "ts_ms", F.lit(1.0).alias("confidence"))


def mirrored(events: DataFrame, shared: int = -1) -> DataFrame:
    """Events, and a copy of each in the shared session that keeps where it came from."""
    own = events.withColumn("scope", F.lit("private")).withColumn("source_session", F.col("session_id"))
    copy = own.withColumn("scope", F.lit("shared")).withColumn("session_id", F.lit(shared).cast(events.schema["session_id"].dataType))
    return own.unionByName(copy)
