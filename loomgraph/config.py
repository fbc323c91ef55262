"""Settings as frozen values; nothing is shared between callers."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    min_user_messages: int = 2
    error_chars: int = 200
    batch_chunks: int = 16
    chunk_tokens: int = 3000
    prompt_tokens: int = 30_000
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    inner_rrf_k: int = 60
    outer_rrf_k: int = 30
    graph_weight: float = 0.3
    rerank_multiplier: float = 2.0
    candidate_multiplier: int = 5
    align_threshold: float = 0.92
    cooccurrence_cap: int = 15
    graph_depth: int = 1
    graph_nodes: int = 30
    graph_tasks: int = 50
    summary_budget: int = 12_000
    max_tasks: int = 10


def from_nested(settings: dict[str, Any] | None) -> Config:
    """A Config from nested settings; the last part of a dotted path names the field, unknown ones are left out."""
    known, found = {f.name for f in fields(Config)}, {}

    def walk(level: dict) -> None:
        for key, value in level.items():
            if isinstance(value, dict):
                walk(value)
            elif key in known:
                found[key] = value

    walk(settings or {})
    return replace(Config(), **found)


def get(settings: dict[str, Any], path: str, default: Any = None) -> Any:
    """The value at a dotted path, or the default."""
    for part in path.split("."):
        if not isinstance(settings, dict) or part not in settings:
            return default
        settings = settings[part]
    return settings


def put(settings: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A copy of the settings with the value at a dotted path, levels made as needed."""
    first, _, rest = path.partition(".")
    below = settings.get(first)
    return settings | {first: put(below if isinstance(below, dict) else {}, rest, value) if rest else value}
