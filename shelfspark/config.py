"""Settings with the defaults that define results. All are parameters of the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_chars: int = 1000
    chunk_overlap_chars: int = 150
    min_chunk_chars: int = 300
    candidate_pool: int = 50
    rerank_pool: int = 30
    top_k: int = 6
    overview_chunks: int = 10
    min_relevance: float = 0.1
    not_found_relevance: float = 4.5e-5
    max_file_mb: int = 100
    embed_model: str = "hashed-words-384"
    rrf_k: int = 60
    k1: float = 1.2
    b: float = 0.75
    weights: tuple[float, float, float] = (1.0, 0.6, 0.3)
    history_turns: int = 3
    history_chars: int = 600
    snippet_chars: int = 400
    pipeline_version: str = "2"

    def fingerprint(self) -> str:
        """Changes whenever an index built with other settings must be built anew."""
        parts = (self.pipeline_version, self.embed_model, self.chunk_chars, self.chunk_overlap_chars, self.min_chunk_chars)
        return "|".join(map(str, parts))
