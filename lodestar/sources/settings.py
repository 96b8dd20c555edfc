"""Query defaults, kept as JSON: a seed, what the file adds, and partial changes that are clamped."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from lodestar.operators.chunking import STRATEGIES


@dataclass
class Settings:
    top_k: int = 10
    threshold: float = 0.25
    rerank: bool = True
    rerank_recall: int = 30
    bm25_enabled: bool = True
    fusion_method: str = "rrf"
    chunk_size: int = 500
    chunk_overlap_percent: int = 30
    chunk_strategy: str = "window"
    query_max_chars: int = 500
    default_collection: str = ""
    web_provider: str = ""
    web_count: int = 10
    freshness_days: int = 0
    safesearch: int = 0
    country: str = ""
    vector_dim: int = 0
    embed_model: str = ""
    embed_provider: str = ""
    vector_distance: str = "cosine"
    category_rules: list = field(default_factory=list)

    def checked(self) -> Settings:
        """Out-of-range values moved to the nearest allowed ones; unknown names refused."""
        if self.chunk_strategy not in STRATEGIES:
            raise ValueError(f"unknown chunk strategy {self.chunk_strategy!r}")
        if self.fusion_method != "rrf":
            raise ValueError(f"fusion method {self.fusion_method!r} is not supported")
        for name in ("top_k", "rerank_recall", "chunk_size", "query_max_chars", "freshness_days", "vector_dim"):
            setattr(self, name, max(0, int(getattr(self, name))))
        self.threshold = max(0.0, float(self.threshold))
        self.web_count, self.safesearch = min(max(self.web_count, 0), 50), min(max(self.safesearch, 0), 2)
        self.chunk_overlap_percent = min(max(self.chunk_overlap_percent, 0), 90)
        self.country = self.country.strip().upper()
        return self

    def patched(self, **changes) -> Settings:
        """A copy with the given values; None leaves a value as it is."""
        known = {f.name for f in fields(self)}
        if odd := set(changes) - known:
            raise ValueError(f"unknown settings: {sorted(odd)}")
        return Settings(**(asdict(self) | {k: v for k, v in changes.items() if v is not None})).checked()


def load(path: str | None = None) -> Settings:
    """The defaults with what the file holds; a missing file means the defaults, a broken one is an error."""
    if not path or not os.path.exists(path):
        return Settings()
    with open(path, encoding="utf-8") as f:
        known = {x.name for x in fields(Settings)}
        return Settings().patched(**{k: v for k, v in json.load(f).items() if k in known})


def save(settings: Settings, path: str) -> None:
    aside = f"{path}.new"
    with open(aside, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=2)
    os.replace(aside, path)
