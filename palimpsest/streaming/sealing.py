"""A sealing stream that gives out blocks: typed state for each session, event-time timers for idle ones.

A session's state is the counters of its open block and that block's events, so it is as long as a block and
not as a session.  The rules are those of the batch fold.  A block leaves the stream once, when it closes; an
idle one closes by timer, without a next event.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.functions import text as T
from palimpsest.operators import seal
from palimpsest.shipping import ship_for_state
from palimpsest.sources import tables
from palimpsest.sources.config import DEFAULT, Config
from palimpsest.storage import setting

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENT = "event_id string, role string, text string, ts_ms bigint"
FOLD = "block bigint, tokens bigint, over boolean, started boolean, ts_ms bigint, timer bigint"
BLOCKS = f"session_id bigint, block_seq bigint, start_ms bigint, end_ms bigint, token_count bigint, raw_events array<{tables.EVENT}>, sealed boolean"


class Sealer(StatefulProcessor):
    """idle_ms: an idle session's block closes so long after its last event; with keep_open every batch also gives the block still open."""

    def __init__(self, cfg: Config, idle_ms: int | None, keep_open: bool):
        self.cfg, self.idle_ms, self.keep_open = cfg, idle_ms, keep_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("fold", FOLD)
        self.events = handle.getListState("events", EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fold, held, before, timer = seal.Fold(self.cfg), [], None, None
        if self.counters.exists():
            fold.block, fold.tokens, fold.over, started, before, timer = self.counters.get()
            held = [tuple(e) for e in self.events.get()] if not fold.over else []
            # What the rules ask of the last event; a closed block answers by itself.
            fold.last = (held[-1][1], held[-1][2], held[-1][3]) if held else ("", "", before) if started else None
        for r in sorted(rows, key=lambda r: r.seq):
            before = r.ts_ms if before is None else max(r.ts_ms, before + 1)
            block, tokens = fold.block, fold.tokens
            if fold.add(r.role, r.text, before, r.tokens) != block and held:
                yield self._block(key[0], block, tokens, held, True)
                held = []
            held.append((f"{key[0]}#{r.seq}", r.role, r.text, before))
            if fold.over:  # closed with this event in it
                yield self._block(key[0], fold.block, fold.tokens, held, True)
                held = []
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None
        if held:
            self.events.put(held)
            if self.idle_ms is not None:
                timer = before + self.idle_ms
                self.handle.registerTimer(timer)
            if self.keep_open:
                yield self._block(key[0], fold.block, fold.tokens, held, False)
        else:
            self.events.clear()
        self.counters.update((fold.block, fold.tokens, fold.over, True, before, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        block, tokens, _, started, before, _ = self.counters.get()
        held = [tuple(e) for e in self.events.get()]
        if held:
            yield self._block(key[0], block, tokens, held, True)
        self.events.clear()
        self.counters.update((block, tokens, True, started, before, None))

    def close(self) -> None:
        pass

    @staticmethod
    def _block(session: int, block: int, tokens: int, held: list[tuple], sealed: bool) -> Row:
        return Row(session_id=session, block_seq=block, start_ms=min(e[3] for e in held), end_ms=max(e[3] for e in held), token_count=tokens, raw_events=[Row(event_id=e[0], role=e[1], text=e[2], ts_ms=e[3]) for e in held], sealed=sealed)


def block_stream(events: DataFrame, cfg: Config = DEFAULT, late: str | None = None, keep_open: bool = False) -> DataFrame:
    """Blocks as they close, from a stream of events (session_id, seq, role, text, ts_ms), as to_blocks gives them, with sealed.

    late: how long after the newest event older ones may still come.  With it idle sessions close by event-time
    timers, and events behind that watermark are left out, as in any such stream; without it no event is ever
    too late, and an idle block closes with its session's next event.  keep_open: the open block of each
    session that a batch touched comes too, with sealed false; a later batch gives the block again.
    A query of this stream starts inside with_state.
    """
    ship_for_state(events.sparkSession)
    x = events.select("session_id", "seq", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ts_ms", F.lit(0)).alias("ts_ms"), T.estimate_tokens("text").alias("tokens"))
    idle_ms = None
    if late is not None:
        x = x.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", late)
        idle_ms = int(cfg.proactive_seal_idle_seconds * 1000) if cfg.proactive_seal_enabled else None
    mode = "EventTime" if late is not None else "None"
    x = x.groupBy("session_id").transformWithState(Sealer(cfg, idle_ms, keep_open), BLOCKS, "Append" if not keep_open else "Update", mode)
    return x.withColumn("block_id", seal.block_id(F.col("session_id"), F.col("block_seq")))


def with_state(spark: SparkSession):
    """While a query starts: the state store that keyed state with timers needs."""
    return setting(spark, *PROVIDER)
