"""Configuration: defaults, then a TOML file, then the environment, then overrides; values are checked."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from collections.abc import Mapping


@dataclasses.dataclass(frozen=True)
class Config:
    max_tokens_per_block: int = 320
    min_tokens_per_block: int = 120
    proactive_seal_enabled: bool = True
    proactive_seal_idle_seconds: int = 300
    proactive_seal_turn_boundary: bool = True
    proactive_seal_min_tokens: int = 1
    chunk_strategy: str = "hybrid"
    recent_event_window: int = 6
    semantic_top_k: int = 6
    final_top_k: int = 8
    relation_depth: int = 1
    graph_expansion_top_k: int = 4
    keyword_weight: float = 0.45
    vector_weight: float = 0.55
    graph_weight: float = 0.3
    vector_min_score: float = 0.0
    compression_high_match_threshold: float = 0.82
    compression_low_match_threshold: float = 0.35
    compression_soft_band: float = 0.08
    compression_preserve_weight: float = 0.7
    compression_min_raw_tokens: int = 56
    conflict_marker_enabled: bool = True
    prediction_top_k: int = 3
    prediction_walk_depth: int = 2
    prediction_active_threshold: float = 0.45
    prediction_force_active_trigger: bool = False
    prediction_transition_decay: float = 0.75
    prediction_boost_weight: float = 0.25
    prediction_dense_boost_multiplier: float = 0.054
    prediction_boost_cap: float = 0.14
    prediction_base_score_gate_max: float = 0.14
    prediction_dense_confidence_gate_min: float = 0.5
    embedding_dim: int = 256
    embedding_seed: int = 0
    important_threshold: float = 0.6
    search_top_k: int = 5
    proactive_wakeup_enabled: bool = False
    proactive_wakeup_min_interval_seconds: int = 600
    proactive_wakeup_max_per_hour: int = 3
    low_entropy_trigger_enabled: bool = True
    low_entropy_window_size: int = 6
    low_entropy_min_signals: int = 2
    low_entropy_novelty_max: float = 0.2
    low_entropy_retrieval_overlap_min: float = 0.7
    low_entropy_prediction_weight_max: float = 0.02
    low_entropy_relation_new_rate_max: float = 0.2
    low_entropy_graph_coverage_max: float = 0.3
    low_entropy_relation_confidence_max: float = 0.3
    low_entropy_soft_streak_k: int = 2
    low_entropy_hard_streak_k: int = 4
    low_entropy_soft_cooldown_seconds: int = 300
    low_entropy_hard_cooldown_seconds: int = 900
    topic_shift_trigger_enabled: bool = True
    topic_shift_min_keywords: int = 2
    topic_shift_min_tokens: int = 3
    topic_shift_query_similarity_soft_max: float = 0.35
    topic_shift_query_similarity_hard_max: float = 0.2
    topic_shift_keyword_overlap_soft_max: float = 0.3
    topic_shift_keyword_overlap_hard_max: float = 0.15
    topic_shift_retrieval_overlap_soft_max: float = 0.35
    topic_shift_retrieval_overlap_hard_max: float = 0.2
    topic_shift_soft_cooldown_seconds: int = 180
    topic_shift_hard_cooldown_seconds: int = 600
    relation_trigger_enabled: bool = True
    relation_trigger_streak_required: int = 3
    relation_trigger_cooldown_seconds: int = 900
    relation_trigger_low_info_threshold: float = 0.25
    relation_trigger_high_entropy_threshold: float = 0.75
    relation_trigger_short_chain_max_size: int = 2
    relation_min_confidence: float = 0.35
    chunk_target_tokens: int = 1000
    chunk_max_tokens: int = 1400
    chunk_max_blocks: int = 8
    chunk_max_gap_ms: int = 900_000
    chunk_neighbor_expand: bool = False
    chunk_neighbor_window: int = 1
    chunk_neighbor_score_gate: float = 0.75
    chunk_max_expanded_blocks: int = 4
    hybrid_prescreen_ratio: float = 0.05
    hybrid_prescreen_min: int = 20
    hybrid_prescreen_max: int = 100
    hybrid_rerank_multiplier: float = 3
    hybrid_rerank_hard_cap: int = 16
    hybrid_early_stop_min_gap: float = 0.12
    hybrid_rerank_text_max_chars: int = 512
    prefetch_ttl_seconds: int = 1800
    prefetch_boost_ratio: float = 0.6
    vector_search: str = "exact"
    timer_probe_query: str = "__timer_probe__"

    def __post_init__(self):
        for f in dataclasses.fields(self):
            value, kind = getattr(self, f.name), {"int": int, "float": (int, float), "bool": bool, "str": str}[f.type]
            if not isinstance(value, kind) or (f.type != "bool" and isinstance(value, bool)):
                raise ValueError(f"{f.name}: {value!r} is not of type {f.type}")
            if f.type in ("int", "float") and value < 0 and f.name != "embedding_seed":
                raise ValueError(f"{f.name}: {value!r} is below 0")
        for name in ("keyword_weight", "vector_weight", "relation_min_confidence", "prediction_active_threshold", "important_threshold", "compression_high_match_threshold", "compression_low_match_threshold"):
            if getattr(self, name) > 1:
                raise ValueError(f"{name}: {getattr(self, name)!r} is over 1")
        if self.vector_search not in ("exact", "lsh", "two_stage"):
            raise ValueError(f"vector_search: {self.vector_search!r}")
        if self.chunk_strategy not in ("fixed", "semantic", "hybrid"):
            raise ValueError(f"chunk_strategy: {self.chunk_strategy!r}")


def _cast(kind: str, text: str):
    if kind == "bool":
        if text.lower() not in ("true", "false", "1", "0", "yes", "no", "on", "off"):
            raise ValueError(f"{text!r} is no boolean")
        return text.lower() in ("true", "1", "yes", "on")
    return {"int": int, "float": float, "str": str}[kind](text)


def load(toml_path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "PALIMPSEST_", **overrides) -> Config:
    """Later sources win: defaults, [manager] or top level of the TOML file, PREFIX_NAME variables, overrides."""
    kinds = {f.name: f.type for f in dataclasses.fields(Config)}
    values = {}
    if toml_path and os.path.exists(toml_path):
        with open(toml_path, "rb") as f:
            found = tomllib.load(f)
        values |= {k: v for k, v in (found | found.get("manager", {})).items() if k in kinds}
    env = os.environ if env is None else env
    values |= {k: _cast(kinds[k], env[prefix + k.upper()]) for k in kinds if prefix + k.upper() in env}
    unknown = set(overrides) - set(kinds)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Config(**values | overrides)


DEFAULT = Config()
