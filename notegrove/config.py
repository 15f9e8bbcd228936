"""Configuration with the documented defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Chunking:
    size: int = 1000
    overlap: int = 200
    min_section: int = 200


@dataclass(frozen=True)
class Harvest:
    semantic_threshold: float = 0.88
    sample: int = 5
    neighbours: int = 3
    duplicate_action: str = "skip"


@dataclass(frozen=True)
class Review:
    auto_approve: float = 0.85
    dedupe_threshold: float = 0.90
    batch: int = 20


@dataclass(frozen=True)
class Garden:
    min_cluster_size: int = 5
    min_notes: int = 3
    neighbours: int = 15
    threshold: float = 0.7


@dataclass(frozen=True)
class Graph:
    hops: int = 1
    decay: float = 0.5
    most: int = 10
    article_hops: int = 2


@dataclass(frozen=True)
class Answer:
    topk_link: int = 5
    topk_ask: int = 8
    topk_article: int = 20
    ask_chars: int = 1500
    article_notes: int = 24
    article_chars: int = 1200


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    harvest: Harvest = field(default_factory=Harvest)
    review: Review = field(default_factory=Review)
    garden: Garden = field(default_factory=Garden)
    graph: Graph = field(default_factory=Graph)
    answer: Answer = field(default_factory=Answer)


def load(path: str | None = None) -> Config:
    """Defaults overlaid by a YAML file; unknown keys raise."""
    if path is None:
        return Config()
    import yaml

    with open(path, encoding="utf-8") as f:
        return _overlaid(Config(), yaml.safe_load(f) or {})


def _overlaid(base, values: dict):
    known = {f.name for f in fields(base)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return type(base)(**{n: _overlaid(getattr(base, n), values[n]) if n in values and is_dataclass(getattr(base, n)) else values.get(n, getattr(base, n)) for n in known})


def flatten_taxonomy(pillars: list[dict]) -> list[tuple[str, str, str]]:
    """(pillar, category, topic) rows in order; a category without topics has one row with an empty topic."""
    return [(p["name"], c["name"], t) for p in pillars for c in p.get("categories", []) for t in (c.get("topics") or [""])]


def allowed_topics(pillars: list[dict], override: list[str] | None = None) -> list[str]:
    """Categories in order, once each; an override list wins."""
    return list(dict.fromkeys(override)) if override else list(dict.fromkeys(c for _, c, _ in flatten_taxonomy(pillars)))
