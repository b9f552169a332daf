"""Settings of the retrieval engine; defaults are part of the semantics."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default: str) -> str:
    return os.environ.get(name, default)


@dataclass(frozen=True)
class Settings:
    scoped_top_k: int = 30
    rerank_top_k: int = 5
    context_passages: int = 10
    cosine_weight: float = 0.6
    lexical_weight: float = 0.4
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_share: float = 0.6
    ngram_share: float = 0.4
    ngram_n: int = 3
    token_budget: int = 4000
    token_per_word: float = 1.35
    chunk_chars: int = 700
    chunk_overlap: int = 150
    max_tree_depth: int = 6
    max_descent_calls: int = 8
    descent_min_nodes: int = 25
    frontier_cap: int = 25
    heat_concentration: float = 0.1
    heat_top: int = 3
    summary_share: float = 0.5
    bookmark_min: int = 3
    bookmark_max_share: float = 0.25
    ablation: str = field(default_factory=lambda: _env("ABLATION", "none"))
    parser: str = field(default_factory=lambda: _env("PARSER", "auto"))
    use_llm_summaries: bool = field(default_factory=lambda: _env("USE_LLM_SUMMARIES", "true").lower() == "true")


DEFAULT = Settings()
