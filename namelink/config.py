"""Configuration of a linkage run; every field is checked when the object is made."""

from __future__ import annotations

from dataclasses import dataclass

# Legal-form and filler words that normalisation drops.
SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "llp", "co", "company", "group", "holdings", "partners",
    "enterprises", "international", "global", "industries", "solutions", "plc", "ag", "sa", "nv", "bv", "gmbh", "spa",
)
MODES = ("fixed", "adaptive_gmm", "hac")
LINKAGES = ("average", "single", "complete", "ward")


@dataclass(frozen=True)
class Config:
    mode: str = "fixed"
    similarity_threshold: float = 0.85
    weight_wratio: float = 0.40
    weight_token_set: float = 0.15
    weight_embedding: float = 0.45
    #: spread the embedding's weight over the two text scores when there are no vectors
    redistribute_weights: bool = False
    suffixes: tuple[str, ...] = SUFFIXES
    hac_threshold: float = 0.42
    hac_linkage: str = "average"
    min_block_size: int = 2
    max_block_pairs: int = 5000
    sample_pairs: int = 50_000
    within_share: float = 0.95
    cross_share: float = 0.05
    proportional_share: float = 0.80
    floor_share: float = 0.20
    seed: int = 42
    gmm_min_samples: int = 50
    fallback_t_high: float = 0.92
    fallback_t_low: float = 0.80
    review: bool = False
    review_low: float = 0.27
    review_high: float = 0.57
    review_strength: float = 0.15
    review_min_confidence: float = 0.60
    review_batch: int = 10
    #: accepted for completeness; an undecided review never changes a similarity
    review_allow_unknown: bool = True

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.mode in MODES, f"mode must be one of {MODES}")
        need(self.hac_linkage in LINKAGES, f"hac_linkage must be one of {LINKAGES}")
        for names in (("weight_wratio", "weight_token_set", "weight_embedding"), ("within_share", "cross_share"), ("proportional_share", "floor_share")):
            need(abs(sum(getattr(self, n) for n in names) - 1) < 1e-9, f"{' + '.join(names)} must be 1")
        shares = ("similarity_threshold", "weight_wratio", "weight_token_set", "weight_embedding", "hac_threshold", "within_share", "cross_share",
                  "proportional_share", "floor_share", "fallback_t_high", "fallback_t_low", "review_low", "review_high", "review_strength", "review_min_confidence")
        for n in shares:
            need(0 <= getattr(self, n) <= 1, f"{n} must be between 0 and 1")
        need(self.fallback_t_low <= self.fallback_t_high and self.review_low <= self.review_high, "lower bounds exceed upper bounds")
        need(self.min_block_size >= 2, "min_block_size must be at least 2")
        for n in ("max_block_pairs", "sample_pairs", "gmm_min_samples", "review_batch"):
            need(getattr(self, n) > 0, f"{n} must be positive")
