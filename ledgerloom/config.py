"""Engine settings: one frozen dataclass, every field is read somewhere."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # retrieval
    top_k: int = 5
    bm25_weight: float = 0.5
    vector_weight: float = 0.5
    enable_hybrid: bool = True
    chunk_size: int = 512
    chunk_overlap: int = 50
    # BM25 parameters (Okapi with an epsilon floor for negative idf)
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    # reranking
    rerank_enabled: bool = False
    rerank_multiplier: int = 3
    rerank_weight: float = 0.3
    # semantic cache
    cache_enabled: bool = True
    cache_threshold: float = 0.95
    cache_max_entries: int | None = None  # None keeps every answer
    # temporal decay
    decay_enabled: bool = True
    decay_lambda: float = 0.1
    decay_before_cut: bool = False
    max_days_old: int = 365
    # indexing
    table_summary_enabled: bool = True
    embedding_dim: int = 64
    index_buckets: int = 32  # folders that words are hashed to; fixed for the life of an index
    posting_range: int = 4096  # index positions per posting row, likewise fixed
    first_ranges: int = 4  # ranges a query scores before the rest is bounded
    # program generation and execution
    max_retry_attempts: int = 3
    self_consistency: bool = True
    self_consistency_samples: int = 5
    self_consistency_temperature: float = 0.7
    repair_temperature: float = 0.1
    repair_numbers: int = 20
    strict_programs: bool = False
    # verification
    verify_numbers: bool = True
    verify_facts: bool = False
    verify_tolerance: float = 0.01
    program_tolerance: float = 1e-6
    # evaluation
    numerical_tolerance: float = 1e-3
    exact_tolerance: float = 1e-6
    baseline_mode: bool = False
    # scores equal to this many decimals are ties, broken by index order; this
    # keeps rankings independent of the order in which a cluster adds doubles
    score_scale: int = 6
    # bounds below which one side of a join may be broadcast
    broadcast_max_rows: int = 200_000
    query_block_rows: int = 4096
    corpus_block_rows: int = 65_536
    salt_buckets: int = 16
    # keys with more rows than this are spread over salt_buckets partitions
    hot_rows: int = 1_000_000

    def replace(self, **changes) -> "EngineConfig":
        return dataclasses.replace(self, **changes)

    def baseline(self) -> "EngineConfig":
        """The comparison baseline: vector search only, no table summaries, no sampling."""
        return self.replace(
            enable_hybrid=False,
            bm25_weight=0.0,
            vector_weight=1.0,
            table_summary_enabled=False,
            baseline_mode=True,
        )

    @classmethod
    def from_mapping(cls, settings: dict) -> "EngineConfig":
        """Build from a flat mapping; unknown keys raise, numbers given as text are converted."""
        kinds = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        unknown = sorted(set(settings) - set(kinds))
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**{k: v if kinds[k] is bool else kinds[k](v) for k, v in settings.items()})

    @classmethod
    def from_json(cls, path: str) -> "EngineConfig":
        import json

        with open(path, encoding="utf-8") as handle:
            return cls.from_mapping(json.load(handle))
