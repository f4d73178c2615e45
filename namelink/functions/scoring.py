"""Scores and decisions over pairs: plain column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """The vector at length 1 (zero vectors stay), so that cosine is a plain dot product afterwards."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity within [0, 1]; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, clamp(dot(a, b) / norm)).otherwise(0.0)


def confidence(same_norm: Column, wratio: Column, token_set: Column, embedding: Column, bonus: Column, cfg: Config) -> Column:
    """Weighted score in [0, 1]; equal normal forms score 1.  ``embedding`` (0-100) may be null: it then counts as 0."""
    if cfg.redistribute_weights:
        total = cfg.weight_wratio + cfg.weight_token_set
        text = cfg.weight_wratio / total * wratio + cfg.weight_token_set / total * token_set
        whole = cfg.weight_wratio * wratio + cfg.weight_token_set * token_set + cfg.weight_embedding * embedding
        weighted = F.when(embedding.isNull(), text).otherwise(whole)
    else:
        weighted = cfg.weight_wratio * wratio + cfg.weight_token_set * token_set + cfg.weight_embedding * F.coalesce(embedding, F.lit(0.0))
    return F.when(same_norm, 1.0).otherwise(clamp(weighted + bonus, 0.0, 100.0) / 100)


def least_embedding(threshold: float, cfg: Config, most_bonus: float = 4.0) -> float:
    """The embedding score a pair needs at least to reach ``threshold`` whatever its text scores: prunes before the text UDF."""
    if not cfg.weight_embedding:
        return 0.0
    rest = 100 * (cfg.weight_wratio + cfg.weight_token_set) + most_bonus
    return max(0.0, (100 * threshold - rest) / cfg.weight_embedding)


@dataclass(frozen=True)
class Thresholds:
    t_low: float
    s_90: float
    t_high: float


def same_group(score: Column, phonetic: Column, t: Thresholds) -> Column:
    """Accepted outright, or promoted by phonetic agreement in the upper middle zone."""
    return (score >= t.t_high) | ((score >= t.s_90) & (score < t.t_high) & phonetic)


def margin_penalty(score: Column, t: Thresholds) -> Column:
    """0 at t_high and above, 10 at s_90 and below, linear between."""
    width = t.t_high - t.s_90
    between = 10.0 * (t.t_high - score) / width if width > 0 else F.lit(0.0)
    return F.when(score >= t.t_high, 0.0).when(score <= t.s_90, 10.0).otherwise(between)


def adjusted_confidence(score: Column, posterior: Column, phonetic: Column, t: Thresholds) -> Column:
    plus = F.when(phonetic, 4.0).otherwise(0.0)
    accepted = F.least((100 * posterior + plus) / 100, F.lit(1.0))
    promoted = F.least(100 * posterior + 4.0 - margin_penalty(score, t), F.lit(89.0)) / 100
    return F.when(score >= t.t_high, accepted).when((score >= t.s_90) & phonetic, promoted).otherwise(posterior)


def review_adjusted(similarity: Column, decision: Column, certainty: Column, strength: float) -> Column:
    direction = F.when(decision == "same", 1.0).when(decision == "different", -1.0).otherwise(0.0)
    return clamp(similarity + strength * direction * certainty)


@dataclass(frozen=True)
class Mixture:
    """Two normal components of a score distribution."""

    weights: tuple[float, float]
    means: tuple[float, float]
    variances: tuple[float, float]

    @property
    def high(self) -> int:
        return int(self.means[1] > self.means[0])

    def _log(self, k: int) -> tuple[float, float, float]:
        """log of weight times density as a * x^2 + b * x + c."""
        w, m, v = self.weights[k], self.means[k], self.variances[k]
        return -0.5 / v, m / v, math.log(w) - 0.5 * math.log(2 * math.pi * v) - 0.5 * m * m / v

    def log_odds(self) -> tuple[float, float, float]:
        return tuple(h - o for h, o in zip(self._log(self.high), self._log(1 - self.high)))

    def posterior_at(self, x: float) -> float:
        a, b, c = self.log_odds()
        z = a * x * x + b * x + c
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    def posterior(self, x: Column) -> Column:
        """Probability that a score belongs to the high component."""
        a, b, c = self.log_odds()
        return 1 / (1 + F.exp(-clamp(a * x * x + b * x + c, -700.0, 700.0)))

    def threshold(self, target: float) -> float | None:
        """Score at which the posterior is ``target``: 0 or 1 if it lies outside, None if there is none."""
        if target <= self.posterior_at(0.0):
            return 0.0
        if target >= self.posterior_at(1.0):
            return 1.0
        a, b, c = self.log_odds()
        c -= math.log(target / (1 - target))
        if abs(a) < 1e-12:
            roots = [-c / b] if b else []
        else:
            inner = b * b - 4 * a * c
            roots = [(-b + s * math.sqrt(inner)) / (2 * a) for s in (1, -1)] if inner >= 0 else []
        inside = [r for r in roots if 0 <= r <= 1]
        return min(inside, key=lambda r: abs(self.posterior_at(r) - target)) if inside else None

    def thresholds(self) -> Thresholds | None:
        found = [self.threshold(p) for p in (0.02, 0.90, 0.98)]
        return None if None in found else Thresholds(*found)
