"""Options, their defaults and their checks."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .errors import SeqError
from .functions.kernels import NUCLEOTIDE, PROTEIN, PROTEIN_FLAT, Scoring, with_gaps

f32 = np.float32
LEVELS = ("fast", "medium", "sensitive", "ultra")
#: How far each level's screen lies below the wanted identity.
_LOOSER = {"fast": 0.0, "medium": 0.15, "sensitive": 0.30, "ultra": 0.40}


@dataclass(frozen=True)
class Thresholds:
    """Limits of the cascade, all in single precision."""

    prefilter_identity: float
    final_identity: float
    final_coverage: float
    gapped: bool


def thresholds(level: str, min_identity: float, min_coverage: float, sensitivity: float) -> Thresholds:
    """The screen accepts identities below ``min_identity`` by 0.04 for each step of sensitivity
    and by the level's own margin; at level fast, which doesn't align, that screen decides."""
    unit = lambda x: f32(min(max(x, f32(0)), f32(1)))
    loose = f32(0.04) * f32(min(max(sensitivity, 0.0), 10.0))
    margin = loose if level == "fast" else f32(_LOOSER[level]) + loose
    cov = unit(f32(min_coverage) * f32(0.9)) if level == "ultra" else f32(min_coverage)
    return Thresholds(float(unit(f32(min_identity) - margin)), float(f32(min_identity)), float(cov), level != "fast")


@dataclass(frozen=True)
class ClusterOptions:
    min_identity: float = 0.9
    min_coverage: float = 0.8
    cov_mode: int = 0
    kmers_per_seq: int = 20
    k: int | None = None
    sensitivity: float = 1.0
    level: str = "fast"
    dbtype: str = "protein"
    sub_matrix: str = "blosum62"
    gap_open: int | None = None
    gap_extend: int | None = None

    def check(self) -> "ClusterOptions":
        ok = [
            (0 <= self.min_identity <= 1, "min-seq-id must be in [0,1]"), (0 <= self.min_coverage <= 1, "cov must be in [0,1]"),
            (self.cov_mode in (0, 1, 2, 3), "cov-mode must be 0..3"), (self.kmers_per_seq > 0, "kmer-per-seq must be > 0"),
            (self.k is None or self.k > 0, "kmer-size must be > 0"), (self.sensitivity >= 0, "sensitivity must be >= 0"),
            (self.level in LEVELS, f"cascade-level must be one of {', '.join(LEVELS)}"),
        ]
        for good, message in ok:
            if not good:
                raise SeqError("validation", message)
        return self

    @property
    def reduced(self) -> bool:
        return self.dbtype == "protein"

    @property
    def kmer_size(self) -> int:
        return self.k if self.k is not None else 10 if self.reduced else 15

    @property
    def seeds_per_seq(self) -> int:
        return int(np.floor(self.kmers_per_seq * max(self.sensitivity, 1.0) + 0.5))

    @property
    def thresholds(self) -> Thresholds:
        return thresholds(self.level, self.min_identity, self.min_coverage, self.sensitivity)

    @property
    def scoring(self) -> Scoring:
        return scoring_for(self.dbtype, self.sub_matrix, self.gap_open, self.gap_extend)


def scoring_for(dbtype: str, sub_matrix: str = "blosum62", gap_open: int | None = None, gap_extend: int | None = None) -> Scoring:
    base = NUCLEOTIDE if dbtype == "nucleotide" else PROTEIN_FLAT if sub_matrix == "simple" else PROTEIN
    return with_gaps(base, gap_open, gap_extend)


@dataclass(frozen=True)
class IndexOptions:
    k: int = 14
    m: int = 20
    seed: int = 42
    hot_df: int | None = None
    hot_mode: str = "bp128"
    codec: str = "bp128"

    def check(self) -> "IndexOptions":
        if self.k <= 0 or self.m <= 0:
            raise SeqError("validation", "k and m must be > 0")
        if self.hot_mode == "roaring":
            raise SeqError("unsupported", "ROARING_FEATURE_NOT_ENABLED")
        if self.hot_mode not in ("skip", "bp128"):
            raise SeqError("validation", f"unknown hot mode {self.hot_mode}")
        return self


@dataclass(frozen=True)
class SeedPolicy:
    """How long a query's k-mers are: fixed, or by the query's length (syncmer acts as fixed)."""

    mode: str = "fixed_k"
    k_values: tuple[int, ...] = (13, 14, 15)
    m: int = 20
    short_k: int = 13
    long_k: int = 15

    @staticmethod
    def named(mode: str | None, k: int, m: int) -> "SeedPolicy | None":
        return None if mode is None else SeedPolicy(mode, (max(k - 1, 1), k, k + 1), m, max(k - 1, 1), k)


#: Queries of fewer residues are short to a variable-k policy.
SHORT_QUERY = 80


@dataclass(frozen=True)
class SearchOptions:
    k: int = 14
    m: int = 20
    seed: int = 42
    top_k: int = 10
    min_seed_hits: int = 1
    min_identity: float = 0.9
    min_coverage: float = 0.8
    max_df: int | None = None
    prune_quantile: float = 0.90
    max_seeds: int = 128
    work_budget: int | None = None
    policy: SeedPolicy | None = None
    scoring: Scoring = field(default=PROTEIN)
