"""Immutable retrieval configuration; every change returns a new object."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

PATHS = ("vector", "keywords", "summary", "content")
METHODS = ("weighted_rrf", "simple_rrf", "weighted_sum", "max_score")

# Default weight and list length of every path.
DEFAULT_WEIGHTS = {"vector": 0.4, "keywords": 0.3, "summary": 0.2, "content": 0.1}
DEFAULT_TOP_K = {"vector": 50, "keywords": 30, "summary": 20, "content": 20}


@dataclass(frozen=True)
class PathSettings:
    weight: float = 0.25
    top_k: int = 50
    enabled: bool = True
    min_score: float = 0.0
    boost: float = 1.0

    def __post_init__(self):
        if self.weight < 0 or self.min_score < 0:
            raise ValueError("weight and min_score must not be negative")
        if self.top_k <= 0 or self.boost <= 0:
            raise ValueError("top_k and boost must be positive")


@dataclass(frozen=True)
class FusionSettings:
    method: str = "weighted_rrf"
    rrf_k: int = 60
    normalise: bool = True
    final_top_k: int = 20
    diversity_penalty: float = 0.0

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unsupported fusion method: {self.method}")
        if self.rrf_k <= 0 or self.final_top_k <= 0:
            raise ValueError("rrf_k and final_top_k must be positive")
        if not 0 <= self.diversity_penalty <= 1:
            raise ValueError("diversity_penalty must be within [0, 1]")


@dataclass(frozen=True)
class RerankSettings:
    enabled: bool = True
    top_k: int = 10
    batch_size: int = 32
    strategy: str = "score_fusion"

    def __post_init__(self):
        if self.top_k <= 0 or self.batch_size <= 0:
            raise ValueError("top_k and batch_size must be positive")


def _default_paths() -> dict[str, PathSettings]:
    return {p: PathSettings(DEFAULT_WEIGHTS[p], DEFAULT_TOP_K[p]) for p in PATHS}


@dataclass(frozen=True)
class RetrievalConfig:
    paths: dict[str, PathSettings] = field(default_factory=_default_paths)
    fusion: FusionSettings = FusionSettings()
    rerank: RerankSettings = RerankSettings()

    def __post_init__(self):
        if not any(p.enabled and p.weight > 0 for p in self.paths.values()):
            raise ValueError("at least one path must be enabled with a positive weight")
        object.__setattr__(self, "paths", _renormalised(self.paths))

    def enabled(self) -> list[str]:
        return [name for name, p in self.paths.items() if p.enabled]

    def weights(self) -> dict[str, float]:
        return {n: p.weight for n, p in self.paths.items() if p.enabled}

    def top_ks(self) -> dict[str, int]:
        return {n: p.top_k for n, p in self.paths.items() if p.enabled}

    def with_weight(self, path: str, weight: float) -> RetrievalConfig:
        """Set one weight; enabled weights are renormalised to 1, so call order matters."""
        return replace(self, paths={**self.paths, path: replace(self.paths[path], weight=weight)})

    def with_path(self, path: str, enabled: bool) -> RetrievalConfig:
        """Switch a path; weights are renormalised only when one is switched on."""
        changed = {**self.paths, path: replace(self.paths[path], enabled=enabled)}
        out = replace(self, paths=changed)
        if not enabled:
            object.__setattr__(out, "paths", changed)
        return out

    def with_fusion(self, **changes: Any) -> RetrievalConfig:
        return _keeping_weights(self, fusion=replace(self.fusion, **changes))

    def with_rerank(self, **changes: Any) -> RetrievalConfig:
        return _keeping_weights(self, rerank=replace(self.rerank, **changes))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def from_dict(data: dict[str, Any]) -> RetrievalConfig:
        out = RetrievalConfig(
            {n: PathSettings(**p) for n, p in data["paths"].items()},
            FusionSettings(**data.get("fusion", {})),
            RerankSettings(**data.get("rerank", {})),
        )
        return out

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2)

    @staticmethod
    def load(path: str) -> RetrievalConfig:
        with open(path, encoding="utf-8") as f:
            return RetrievalConfig.from_dict(json.load(f))


def _renormalised(paths: dict[str, PathSettings]) -> dict[str, PathSettings]:
    total = sum(p.weight for p in paths.values() if p.enabled)
    return {
        n: replace(p, weight=p.weight / total) if p.enabled and total > 0 else p
        for n, p in paths.items()
    }


def _keeping_weights(config: RetrievalConfig, **changes: Any) -> RetrievalConfig:
    out = replace(config, **changes)
    object.__setattr__(out, "paths", config.paths)
    return out


def preset(name: str) -> RetrievalConfig:
    """Named configurations; weights follow from the order of the steps."""
    base = RetrievalConfig()
    if name == "balanced":
        return base
    if name == "vector_focused":
        return (
            base.with_weight("vector", 0.7).with_weight("keywords", 0.2)
            .with_weight("summary", 0.1).with_path("content", False)
        )
    if name == "keyword_focused":
        return (
            base.with_weight("vector", 0.2).with_weight("keywords", 0.5)
            .with_weight("summary", 0.2).with_weight("content", 0.1)
        )
    if name == "fast_retrieval":
        return (
            base.with_path("summary", False).with_path("content", False)
            .with_weight("vector", 0.7).with_weight("keywords", 0.3)
            .with_rerank(enabled=False)
        )
    if name == "high_precision":
        return base.with_fusion(method="weighted_rrf", rrf_k=30).with_rerank(top_k=15)
    raise ValueError(f"unknown preset: {name}")
