"""Proactive streams with typed state that expires: staged predictions, and wake-ups of quiet sessions by timer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators import detect
from palimpsest.shipping import ship_for_state
from palimpsest.sources.config import DEFAULT, Config

BOOSTS = "session_id bigint, seq bigint, block_id string, boost double"
WAKEUPS = "session_id bigint, now bigint, idle_seconds bigint, admitted boolean"


class Prefetch(StatefulProcessor):
    """What a session's earlier query staged for its next one; the rules are the detector's gate."""

    def __init__(self, cfg: Config):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trigger = handle.getValueState("trigger", "at bigint, timer bigint")
        self.staged = handle.getMapState("staged", "block_id string", "confidence double, at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        detector, timer, now = detect.Detector(self.cfg), None, 0
        if self.trigger.exists():
            detector.trigger, timer = self.trigger.get()
        if self.staged.exists():
            detector.prefetched = {k[0]: tuple(v) for k, v in self.staged.iterator()}
        for r in sorted(rows, key=lambda r: r.seq):
            q = detect.as_query(r.asDict())
            now = max(now, q["now"])
            for block, boost in detector.prefetch_boosts(q["now"]).items():
                yield Row(session_id=key[0], seq=r.seq, block_id=block, boost=boost)
            detector.gate(q)
        self.staged.clear()
        for block, (confidence, at) in detector.prefetched.items():
            self.staged.updateValue((block,), (float(confidence), at))
        if timer is not None:
            self.handle.deleteTimer(timer)
        # Behind this moment neither what is staged nor the gate's cooldown means anything.
        timer = (now + max(self.cfg.prefetch_ttl_seconds, detect.COOLDOWN)) * 1000 + 1
        self.handle.registerTimer(timer)
        self.trigger.update((detector.trigger, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.staged.clear()
        self.trigger.clear()
        yield from ()

    def close(self) -> None:
        pass


def boost_stream(log: DataFrame, cfg: Config = DEFAULT, late: str = "1 minute") -> DataFrame:
    """Streaming twin of detect.staged over logged queries (columns of detect.LOG; now in seconds is the event time).

    Nothing of a session is held once its staged predictions are out of date.  Starts inside sealing.with_state.
    """
    ship_for_state(log.sparkSession)
    x = log.withColumn("_at", F.timestamp_seconds("now")).withWatermark("_at", late)
    return x.groupBy("session_id").transformWithState(Prefetch(cfg), BOOSTS, "Append", "EventTime")


class Waker(StatefulProcessor):
    """Ticks of a quiet session every interval after its last activity, and which of them the budget admits."""

    def __init__(self, cfg: Config, interval: int, forget: int):
        self.cfg, self.interval, self.forget = cfg, interval, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last bigint, timer bigint, given array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, timer, given = self.state.get() if self.state.exists() else (None, None, [])
        newest = max(r.now for r in rows)
        if last is None or newest > last:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = (newest + self.interval) * 1000
            self.handle.registerTimer(timer)
            self.state.update((newest, timer, list(given)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, timer, given = self.state.get()
        budget, until = detect.Budget(self.cfg, given), timerValues.getCurrentWatermarkInMs()
        # A watermark may pass several ticks at once.
        while timer < until and timer // 1000 - last <= self.forget:
            now = timer // 1000
            yield Row(session_id=key[0], now=now, idle_seconds=now - last, admitted=budget.admits(now))
            timer += self.interval * 1000
        if timer // 1000 - last > self.forget:
            self.state.clear()
        else:
            self.handle.registerTimer(timer)
            self.state.update((last, timer, list(budget.given)))

    def close(self) -> None:
        pass


def wakeup_stream(activity: DataFrame, cfg: Config = DEFAULT, interval: int = 300, forget: int = 7200, late: str = "1 minute") -> DataFrame:
    """session_id, now, idle_seconds, admitted: a tick every interval seconds in which a session (session_id, now in seconds) stays quiet.

    The budget is that of detect.planned.  After forget quiet seconds nothing of the session is held.
    Starts inside sealing.with_state.
    """
    ship_for_state(activity.sparkSession)
    x = activity.select("session_id", "now", F.timestamp_seconds("now").alias("_at")).withWatermark("_at", late)
    return x.groupBy("session_id").transformWithState(Waker(cfg, interval, forget), WAKEUPS, "Append", "EventTime")
