"""Parameters of the operators with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EtlConfig:
    """Ingest: length gate in code points, duplicates, cap on rows."""

    min_length: int = 3
    max_length: int = 1000
    deduplicate: bool = True
    max_rows: int | None = None


@dataclass(frozen=True)
class ConsensusConfig:
    """Votes of several runs."""

    threshold: float = 0.67
    rule_boost: float = 0.1
    min_confidence: float = 0.5
    strict: bool = True


@dataclass(frozen=True)
class QualityConfig:
    """Gate of synthetic texts."""

    min_cosine: float = 0.3
    max_cosine: float = 0.95
    max_ratio: float = 0.8
    min_changes: int = 3
    max_features: int = 5000


@dataclass(frozen=True)
class WriterConfig:
    """Balanced and split data sets."""

    eval_fraction: float = 0.1
    min_eval: int = 50
    min_per_domain: int = 5
    max_per_domain: int | None = None
    seed: int = 42
    leak_safe: bool = False


@dataclass(frozen=True)
class FeedbackConfig:
    """Examples from corrections."""

    per_domain: int = 3
    window_days: int = 30
    min_length: int = 5
    max_length: int = 200
