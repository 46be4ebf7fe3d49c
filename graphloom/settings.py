"""Settings with the defaults of the retrieval lanes; the environment may override them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1200
    chunk_overlap: int = 150
    max_context_facts: int = 20
    max_citations: int = 6
    max_concurrent_extractions: int = 5
    seed_limit: int = 3
    seed_min_score: float = 0.45
    chunk_candidates: int = 20
    chunk_min_score: float = 0.25
    top_k_chunks: int = 5
    rrf_k: int = 60
    rerank_above: int = 20
    rerank_pool: int = 40
    hops: int = 2
    similarity_top_k: int = 10
    top_k_communities: int = 3
    max_cluster_size: int = 5
    max_triplets_per_chunk: int = 5
    extraction_workers: int = 2
    answer_temperature: float = 0.1


#: What comes before a setting's upper-case name in the environment.
PREFIX = "GRAPHLOOM_"


def from_environment(given: Mapping[str, str] | None = None) -> Settings:
    """The defaults, with what the environment has under PREFIX; ValueError on a value that is no number."""
    given, found = os.environ if given is None else given, {}
    for f in fields(Settings):
        if (text := given.get(PREFIX + f.name.upper())) is not None:
            try:
                found[f.name] = type(f.default)(text)
            except ValueError:
                raise ValueError(f"{PREFIX}{f.name.upper()} is {text!r}") from None
    return Settings(**found)


DEFAULTS = from_environment()
