"""Detectors over the sequence of queries: prediction gate, relation trigger, topic shift, low entropy.

Their clocks move only when they fire and their streaks outlive suppressed output, so they are a fold over
each session's queries in order.  The fold is a class that keeps bounded state; batch and stream use it.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.shipping import ship
from palimpsest.sources.config import DEFAULT, Config

LONG_AGO = -(10**15)
#: Seconds in which the gate lets nothing through after it opened.
COOLDOWN = 120


def positive(values) -> list[float]:
    own = [float(v) for v in values if v is not None and math.isfinite(v) and v > 0]
    total = sum(own)
    return [v / total for v in own] if own and total > 0 else []


def entropy(p: list[float], eps: float) -> float:
    return 0.0 if len(p) <= 1 else -sum(x * math.log(x + eps) for x in p) / math.log(len(p))


def jaccard(a: set, b: set) -> float:
    n = len(a | b)
    return len(a & b) / n if n else 0.0


def cosine(a, b) -> float:
    if a is None or b is None or len(a) == 0 or len(a) != len(b):
        return 0.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = math.sqrt(float(a @ a)) * math.sqrt(float(b @ b))
    return float(a @ b) / n if n else 0.0


def signal_weights(histories: list[list[float]]) -> list[float]:
    """Steady signals weigh up to 2, noisy ones down to 0.5; all alike weigh 1."""
    raw = [1.0 if len(h) < 2 else 1 / (float(np.mean((np.array(h) - np.mean(h)) ** 2)) + 0.01) for h in histories]
    low, high = min(raw), max(raw)
    return [1.0] * len(raw) if low == high else [0.5 + (w - low) / (high - low) * 1.5 for w in raw]


def retrieve_gate(values, query, top, prefetch: bool) -> bool:
    p = sorted(positive(values), reverse=True)
    if not p or query is None or top is None or len(query) == 0 or len(top) == 0:
        return False
    reject, accept, margin, near = (0.75, 0.5, 0.05, 0.35) if prefetch else (0.6, 0.3, 0.2, 0.6)
    h = entropy(p, 1e-9)
    return h <= reject and h <= accept and p[0] - (p[1] if len(p) > 1 else 0.0) >= margin and cosine(query, top) >= near


def timing(now, last, first, trigger) -> tuple[bool, str, int, str]:
    """(allow, mode, depth, reason)"""
    if now - trigger < COOLDOWN:
        return False, "none", 0, "cooldown"
    if now - last <= 300:
        return True, "inject", 2 if max(0, last - first) <= 1200 else 1, "inject"
    return (True, "prefetch", 1, "prefetch") if now - last <= 1800 else (False, "none", 0, "idle_too_long")


class Detector:
    """State of a session's detectors.  step() takes one query and returns its signal."""

    def __init__(self, cfg: Config = DEFAULT):
        self.cfg = cfg
        self.trigger = self.relation_hard = self.shift_soft = self.shift_hard = self.low_soft = self.low_hard = LONG_AGO
        self.relation_streak = self.low_streak = 0
        self.last_query = None
        self.window: deque = deque(maxlen=max(1, cfg.low_entropy_window_size))
        self.signals = [deque(maxlen=max(1, cfg.low_entropy_window_size)) for _ in range(6)]
        self.prefetched: dict[str, tuple[float, int]] = {}

    def prefetch_boosts(self, now: int) -> dict[str, float]:
        """Boosts of staged predictions for this query; they count once and not after their time."""
        out = {b: c * self.cfg.prediction_boost_weight * self.cfg.prefetch_boost_ratio for b, (c, at) in self.prefetched.items() if now - at <= self.cfg.prefetch_ttl_seconds}
        self.prefetched = {}
        return out

    def gate(self, q: dict) -> tuple[bool, str, list, str, str]:
        """(allow, mode, intents, reason, hint) of the prediction."""
        intents, now = list(q["intents"] if q["intents"] is not None else []), q["now"]
        if not q["predicted"]:
            return False, "none", [], "no_prediction", "none"
        if self.cfg.prediction_force_active_trigger:
            return True, "inject", intents, "force_active_trigger", "search_optional"
        if q["sparse"]:
            return True, "inject", intents, "keyword_sparse_priority", "search_optional"
        if not q["active"]:
            return False, "none", intents, "inactive_prediction", "none"
        allow, mode, depth, reason = timing(now, q["last"], q["first"], self.trigger)
        if not allow:
            return False, "none", intents, f"timing_blocked:{reason}", "none"
        if q["top_embedding"] is None:
            return False, "none", intents, "missing_semantic_seed", "none"
        if not retrieve_gate([c for _, c in intents], q["embedding"], q["top_embedding"], mode == "prefetch"):
            return False, "none", intents, "retrieve_gate_blocked", "none"
        intents = intents[:depth]
        self.trigger = now
        if mode == "prefetch":
            self.prefetched = {b: (c, now) for b, c in intents}
            return False, "prefetch", intents, "prefetch_only", "none"
        self.prefetched = {}
        return True, "inject", intents, "inject_ready", "search_optional"

    def relation(self, values, now: int) -> tuple[str, str]:
        cfg = self.cfg
        if not cfg.relation_trigger_enabled:
            self.relation_streak = 0
            return "none", "relation_trigger_disabled"
        p = positive(values)
        h = entropy(p, 1e-12)
        short = 0 < len(p) <= max(1, cfg.relation_trigger_short_chain_max_size)
        if not p or not (short or (1 - h < cfg.relation_trigger_low_info_threshold and h > cfg.relation_trigger_high_entropy_threshold)):
            self.relation_streak = 0
            return "none", "relation_direction_guard_failed"
        self.relation_streak += 1
        name = "relation_short_chain" if short else "relation"
        if self.relation_streak < max(1, cfg.relation_trigger_streak_required):
            return "soft", f"{name}_soft_triggered"
        if now - self.relation_hard < cfg.relation_trigger_cooldown_seconds:
            return "none", "relation_cooldown_blocked"
        self.relation_hard = now
        return "hard", f"{name}_hard_triggered"

    def shift(self, q: dict) -> tuple[str, str]:
        cfg, now = self.cfg, q["now"]
        if not cfg.topic_shift_trigger_enabled:
            return "none", "topic_shift_disabled"
        if q["source"] != "user":
            return "none", "topic_shift_non_user_trigger"
        keys, top = {k.lower() for k in q["keywords"]}, set(q["top_ids"])
        if q["n_tokens"] < max(1, cfg.topic_shift_min_tokens) or len(keys) < max(1, cfg.topic_shift_min_keywords):
            return "none", "topic_shift_query_not_informative"
        before, self.last_query = self.last_query, (keys, q["embedding"], top)
        if before is None:
            return "none", "topic_shift_baseline_unavailable"
        found = min(1.0, max(0.0, cosine(q["embedding"], before[1]))), jaccard(keys, before[0]), 1.0 if not top or not before[2] else jaccard(top, before[2])
        low = lambda *most: sum(x <= m for x, m in zip(found, most)) >= 2
        if low(cfg.topic_shift_query_similarity_hard_max, cfg.topic_shift_keyword_overlap_hard_max, cfg.topic_shift_retrieval_overlap_hard_max):
            if now - self.shift_hard < cfg.topic_shift_hard_cooldown_seconds:
                return "none", "topic_shift_hard_cooldown_blocked"
            self.shift_hard = self.shift_soft = now
            return "hard", "topic_shift_hard"
        if low(cfg.topic_shift_query_similarity_soft_max, cfg.topic_shift_keyword_overlap_soft_max, cfg.topic_shift_retrieval_overlap_soft_max):
            if now - self.shift_soft < cfg.topic_shift_soft_cooldown_seconds:
                return "none", "topic_shift_soft_cooldown_blocked"
            self.shift_soft = now
            return "soft", "topic_shift_soft"
        return "none", "topic_shift_not_met"

    def snapshot(self, q: dict) -> list[float]:
        """novelty, overlap, prediction weight, new relations, graph coverage, relation confidence; joins the window."""
        size = max(1, self.cfg.low_entropy_window_size)
        past = list(self.window)[-(size - 1) :] if size > 1 else list(self.window)
        top, graph = set(q["top_ids"]), set(q["graph_ids"])
        overlap = jaccard(top, set().union(*(p[0] for p in past)))
        seen = set().union(*(p[1] for p in past))
        has = len(q["graph_ids"]) > 0
        cover = (len(top & graph) / len(top) if top else 0.0) if has else 1.0
        sure = min(1.0, max(0.0, q["graph_confidence"])) if has else 1.0
        new = sum(b not in seen for b in q["graph_ids"]) / len(q["graph_ids"]) if has else 1.0
        weights = [p[2] for p in past] + [q["prediction_weight"]]
        weight = sum(weights) / len(weights)  # the window keeps averages, so the next one averages averages
        self.window.append((top, graph, weight))
        values = [1 - overlap, overlap, weight, new, cover, sure]
        for h, v in zip(self.signals, values):
            h.append(v)
        return values

    def low_entropy(self, q: dict) -> tuple[str, str]:
        cfg, now = self.cfg, q["now"]
        novelty, overlap, weight, new, cover, sure = self.snapshot(q)
        on = [novelty < cfg.low_entropy_novelty_max, overlap > cfg.low_entropy_retrieval_overlap_min, weight < cfg.low_entropy_prediction_weight_max, new < cfg.low_entropy_relation_new_rate_max, cover < cfg.low_entropy_graph_coverage_max, sure < cfg.low_entropy_relation_confidence_max]
        w = signal_weights([list(h) for h in self.signals])
        if sum(x for x, b in zip(w, on) if b) < max(1, cfg.low_entropy_min_signals) / 6 * sum(w):
            self.low_streak = 0
            return "none", "low_entropy_not_met"
        self.low_streak += 1
        if self.low_streak >= max(1, cfg.low_entropy_hard_streak_k):
            if now - self.low_hard < cfg.low_entropy_hard_cooldown_seconds:
                return "none", "low_entropy_hard_cooldown_blocked"
            self.low_hard = self.low_soft = now
            return "hard", "low_entropy_hard"
        if self.low_streak >= max(1, cfg.low_entropy_soft_streak_k):
            if now - self.low_soft < cfg.low_entropy_soft_cooldown_seconds:
                return "none", "low_entropy_soft_cooldown_blocked"
            self.low_soft = now
            return "soft", "low_entropy_soft"
        return "none", "low_entropy_streak_accumulating"

    def step(self, q: dict) -> dict:
        """The gate's signal, unless a detector overrides it: relation, then topic shift, then low entropy."""
        boosts = self.prefetch_boosts(q["now"])
        allow, mode, intents, reason, hint = self.gate(q)
        level, why = self.relation([c for _, c in intents], q["now"])
        if level == "none":
            level, why = self.shift(q)
            if level != "none":
                hint = "search_optional"
            elif self.cfg.low_entropy_trigger_enabled:
                level, why = self.low_entropy(q)
                hint = {"hard": "search_required", "soft": "search_optional"}.get(level, hint)
        else:
            hint = "search_required" if level == "hard" else "search_optional"
        if level != "none":
            allow, mode, reason = True, "inject", why
        return {"allow": allow, "mode": mode, "reason": reason, "hint": hint, "level": level, "n_intents": len(intents), "prefetch_boost": sum(boosts.values())}


FIELDS = ("now", "first", "last", "source", "n_tokens", "keywords", "embedding", "top_ids", "graph_ids", "graph_confidence", "prediction_weight", "predicted", "active", "sparse", "intents", "top_embedding")
LOG = "session_id bigint, seq bigint, now bigint, first bigint, last bigint, source string, n_tokens int, keywords array<string>, embedding array<double>, top_ids array<string>, graph_ids array<string>, graph_confidence double, prediction_weight double, predicted boolean, active boolean, sparse boolean, intents array<struct<block_id: string, confidence: double>>, top_embedding array<double>"
SIGNALS = "session_id bigint, seq bigint, allow boolean, mode string, reason string, hint string, level string, n_intents int, prefetch_boost double"


def as_query(row: dict) -> dict:
    q = {k: row[k] for k in FIELDS}
    for k in ("keywords", "top_ids", "graph_ids"):
        q[k] = [] if q[k] is None else list(q[k])
    q["intents"] = [] if q["intents"] is None else [(i["block_id"], i["confidence"]) for i in q["intents"]]
    return q


def fold_signals(batches: Iterator[pd.DataFrame], cfg: Config) -> Iterator[pd.DataFrame]:
    key, detector = None, None
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            if detector is None or row["session_id"] != key:
                key, detector = row["session_id"], Detector(cfg)
            out.append({"session_id": row["session_id"], "seq": row["seq"]} | detector.step(as_query(row)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGNALS.split(", ")])


def detect(log: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A signal for each logged query (columns of LOG), in the order of seq within a session."""
    ship(log.sparkSession)
    x = log.repartition("session_id").sortWithinPartitions("session_id", "seq")
    return x.mapInPandas(lambda it: fold_signals(it, cfg), SIGNALS)


def staged(log: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """session_id, seq, block_id, boost: what a prediction that an earlier query prefetched adds to the scores of this one.

    Only the gate decides on it, and it does not look at scores, so boosts are known before blocks are ranked.
    """
    ship(log.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, detector = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if detector is None or row["session_id"] != key:
                    key, detector = row["session_id"], Detector(cfg)
                q = as_query(row)
                out += [(key, row["seq"], b, v) for b, v in detector.prefetch_boosts(q["now"]).items()]
                detector.gate(q)
            yield pd.DataFrame(out, columns=["session_id", "seq", "block_id", "boost"])

    x = log.repartition("session_id").sortWithinPartitions("session_id", "seq")
    return x.mapInPandas(run, "session_id bigint, seq bigint, block_id string, boost double")


class Budget:
    """Admitted wake-ups of a session: a minimum interval, and so many in a rolling hour."""

    def __init__(self, cfg: Config, given: Iterable[int] = ()):
        self.cfg, self.given = cfg, deque(given)

    def admits(self, now: int) -> bool:
        while self.given and now - self.given[0] > 3600:
            self.given.popleft()
        ok = (not self.given or now - self.given[-1] >= self.cfg.proactive_wakeup_min_interval_seconds) and len(self.given) < max(1, self.cfg.proactive_wakeup_max_per_hour)
        if ok:
            self.given.append(now)
        return ok


def planned(wakeups: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Which wake-ups (session_id, now) the budget admits, in the order of time."""
    ship(wakeups.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, budget = None, None
        for pdf in batches:
            out = []
            for session, now in zip(pdf["session_id"], pdf["now"], strict=True):
                if budget is None or session != key:
                    key, budget = session, Budget(cfg)
                out.append(budget.admits(now))
            yield pdf.assign(admitted=out)

    x = wakeups.select("session_id", "now").repartition("session_id").sortWithinPartitions("session_id", "now")
    return x.mapInPandas(run, "session_id bigint, now bigint, admitted boolean")
