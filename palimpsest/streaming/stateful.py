"""Streams: sealing and detectors with keyed state, idle sessions and event-time windows with watermarks.

The stateful operators use the same classes as the batch folds, so a stream gives what a batch would over
the same rows in the same order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from palimpsest.functions import text as T
from palimpsest.operators import detect, seal
from palimpsest.shipping import ship
from palimpsest.sources.config import DEFAULT, Config

ASSIGNED = "session_id bigint, seq bigint, role string, text string, ts_ms bigint, tokens bigint, block_seq bigint"


def _sorted_rows(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values("seq", kind="stable")


def seal_stream(events: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Streaming twin of assign_blocks: every event with its block, at once; late events keep arrival order.

    State is the open block's counters and last event, one small row a session.
    """
    ship(events.sparkSession)
    x = events.select("session_id", "seq", "role", F.coalesce("text", F.lit("")).alias("text"), "ts_ms", T.estimate_tokens("text").alias("tokens"))

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fold, before = pickle.loads(state.get[0]) if state.exists else (seal.Fold(cfg), None)
        pdf = _sorted_rows(parts)
        times, blocks = [], []
        for role, text, ts, tokens in zip(pdf["role"], pdf["text"], pdf["ts_ms"], pdf["tokens"], strict=True):
            before = ts if before is None else max(ts, before + 1)
            times.append(before)
            blocks.append(fold.add(role, text, before, tokens))
        state.update((pickle.dumps((fold, before)),))
        yield pdf.assign(ts_ms=times, block_seq=blocks)

    return x.groupBy("session_id").applyInPandasWithState(step, ASSIGNED, "state binary", "append", GroupStateTimeout.NoTimeout)


def detect_stream(log: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Streaming twin of detect."""
    ship(log.sparkSession)

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        detector = pickle.loads(state.get[0]) if state.exists else detect.Detector(cfg)
        rows = [{"session_id": r["session_id"], "seq": r["seq"]} | detector.step(detect.as_query(r)) for r in _sorted_rows(parts).to_dict("records")]
        state.update((pickle.dumps(detector),))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in detect.SIGNALS.split(", ")])

    return log.groupBy("session_id").applyInPandasWithState(step, detect.SIGNALS, "state binary", "append", GroupStateTimeout.NoTimeout)


def idle_session_stream(events: DataFrame, by: str, ts: str, idle_seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """Sessions by idle gap: one millisecond below the threshold, as Spark merges at equality and the rule splits."""
    x = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    gap = f"{idle_seconds * 1000 - 1} milliseconds"
    return x.groupBy(by, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n"), F.min("_t").alias("start"), F.max("_t").alias("end")).select(by, "start", "end", "n")


def window_counts(events: DataFrame, ts: str, by: list[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; works on batches and streams."""
    x = events.withColumn("_t", F.col(ts).cast("timestamp"))
    x = x.withWatermark("_t", late) if events.isStreaming else x
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    return x.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Drives a stream over what there is now; with each, through a batch function, else to Parquet."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").outputMode("append").start(path)
    query.awaitTermination()


def scheduled(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 300):
    """A timer: a batch function at a fixed interval, never twice at a time."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(each).start()
