"""Settings with their defaults; integer stages are clamped to 1..8 where the service they drive asks for it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    atomic_max_chars: int = 1800
    recall_k: int = 20
    rerank_top_n: int = 5
    context_budget: int = 4000
    redundancy_threshold: float = 0.92
    sentence_threshold: float = 0.25
    rrf_constant: int = 60
    rrf_weight: float = 0.5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    max_subqueries: int = 3
    memory_top_k: int = 6
    memory_threshold: float = 0.30
    memory_floor: float = 0.45
    semantic_half_life_days: float = 180.0
    episodic_half_life_days: float = 45.0
    semantic_max_idle_days: float = 730.0
    episodic_max_idle_days: float = 180.0
    archive_below: float = 0.15
    breaker_failures: int = 3
    breaker_cooldown_s: float = 60.0
    embedding_batch: int = 10
    parse_concurrency: int = 2
    image_concurrency: int = 4
    summary_concurrency: int = 4
    broadcast_rows: int = 200_000
    literal_terms: int = 5_000

    CLAMPED = ("parse_concurrency", "image_concurrency", "summary_concurrency")

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None, prefix: str = "SCHOLIUM_") -> Settings:
        """Values of SCHOLIUM_<NAME>; what does not parse keeps its default."""
        env, found = os.environ if env is None else env, cls()
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            try:
                value = type(getattr(found, f.name))(raw)
            except ValueError:
                continue
            found = replace(found, **{f.name: min(8, max(1, value)) if f.name in cls.CLAMPED else value})
        return found

    def saved(self, path: str, **changes: object) -> Settings:
        """The changed settings, also written to path as NAME=value lines, in one step."""
        changed = replace(self, **changes)
        with open(f"{path}.tmp", "w", encoding="utf-8") as out:
            out.writelines(f"SCHOLIUM_{f.name.upper()}={getattr(changed, f.name)}\n" for f in fields(changed))
        os.replace(f"{path}.tmp", path)
        return changed


DEFAULTS = Settings()
