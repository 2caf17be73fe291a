"""Engine settings with their ranges."""

from __future__ import annotations

import json
import math
from dataclasses import Field, dataclass, field, fields, replace


def within(default, least: float = 0, above: float | None = None, most: float | None = None):
    """A number with its range: at least ``least``, or above ``above``, and at most ``most`` if that is given."""
    return field(default=default, metadata={"least": least, "above": above, "most": most})


@dataclass(frozen=True)
class EngineConfig:
    """Settings of ingestion and search. The clock is no setting: operations take ``now``."""

    owner: str = ""
    default_session: str = ""
    ttl_seconds: int = within(604800, least=1)
    half_life_days: float = within(3.0, above=0)
    bm25_min_threshold: float = 0.1
    search_result_limit: int = within(20, least=1)
    min_score: float = within(0.2, most=1)
    vector_min_cos: float = within(0.85, most=1)
    relative_min_score_ratio: float = within(0.6, most=1)
    min_results: int = 3
    version_order_enabled: bool = True
    version_sim_threshold: float = within(0.98, most=1)
    version_min_chars: int = 100
    search_query_max_chars: int = within(2000, least=1)
    chunk_threshold: int = within(400, least=50)
    chunk_overlap: int = 100
    access_count_enabled: bool = False
    access_count_weight: float = 0.02
    access_count_max_boost: float = 0.5
    ttl_refresh_on_search: bool = True
    ttl_refresh_top_k: int = 5
    lexical_rerank_enabled: bool = True
    rerank_weight: float = 0.3
    rerank_phrase_weight: float = 0.2
    b_session_match: float = within(1.0, most=1)
    b_session_mismatch: float = within(0.6, most=1)
    skip_code_blocks: bool = False
    embedding_dim: int = within(16, least=1)
    context_max_chars: int = within(9500, least=2000, most=10000)
    repair_batch: int = 200
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    content_weight: float = 1.0
    ngram_weight: float = 0.8

    def with_(self, **changes) -> "EngineConfig":
        return replace(self, **changes)


def problem_of(setting: Field, value) -> str | None:
    """Why ``value`` can't be used for a setting, or None. Numbers without a range of their own are at least 0."""
    kind = type(setting.default)
    if kind in (bool, str):
        return None if isinstance(value, kind) else f"must be {'true or false' if kind is bool else 'a string'}"
    if type(value) not in ((int,) if kind is int else (int, float)) or not math.isfinite(value):
        return "must be an integer" if kind is int else "must be a number"
    limits = setting.metadata or {"least": 0, "above": None, "most": None}
    low = value > limits["above"] if limits["above"] is not None else value >= limits["least"]
    return None if low and (limits["most"] is None or value <= limits["most"]) else "is out of range"


def from_mapping(values: dict) -> tuple[EngineConfig, list[str]]:
    """Settings from a mapping; a bad value is left at its default and reported, unknown names are ignored.

    An overlap that is not below the chunk threshold becomes a quarter of it.
    """
    named = [setting for setting in fields(EngineConfig) if setting.name in values]
    why = {setting.name: problem_of(setting, values[setting.name]) for setting in named}
    notes = [f"{name} {told}" for name, told in why.items() if told]
    done = replace(EngineConfig(), **{name: values[name] for name, told in why.items() if not told})
    if done.chunk_overlap >= done.chunk_threshold:
        notes.append("chunk_overlap must be below chunk_threshold")
        done = replace(done, chunk_overlap=done.chunk_threshold // 4)
    return done, notes


def load(path: str) -> tuple[EngineConfig, list[str]]:
    """Settings from a JSON file; a missing or unreadable one gives the defaults and a note."""
    try:
        with open(path, encoding="utf-8-sig") as f:
            values = json.load(f)
    except (OSError, ValueError) as e:
        return EngineConfig(), [f"{path}: {e}"]
    return from_mapping(values) if isinstance(values, dict) else (EngineConfig(), [f"{path}: no object"])
