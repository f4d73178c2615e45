"""Two-component mixture over pair scores, and the thresholds that follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import Mixture

#: Scores are collected as a histogram of so many bins: a fixed size, whatever the sample.
BINS = 20_000
FLOOR = 1e-6


def fit(values: np.ndarray, weights: np.ndarray, steps: int = 200, tolerance: float = 1e-3) -> Mixture:
    """EM from a two-means start (the lower centre at the mean, the upper at the maximum); variances are floored."""
    total = weights.sum()
    centres = np.array([np.average(values, weights=weights), values.max()], float)
    for _ in range(100):
        near = (np.abs(values - centres[1]) < np.abs(values - centres[0])).astype(int)
        new = np.array([np.average(values[near == k], weights=weights[near == k]) if weights[near == k].sum() else centres[k] for k in (0, 1)])
        if np.allclose(new, centres):
            break
        centres = new
    share = np.stack([near == 0, near == 1]).astype(float)
    before = -np.inf
    for _ in range(steps):
        mass = (share * weights).sum(axis=1) + 1e-12
        means = (share * weights) @ values / mass
        variances = np.array([(share[k] * weights) @ (values - means[k]) ** 2 / mass[k] for k in (0, 1)]) + FLOOR
        logs = np.log(mass / total)[:, None] - 0.5 * np.log(2 * np.pi * variances)[:, None] - 0.5 * (values - means[:, None]) ** 2 / variances[:, None]
        top = logs.max(axis=0)
        norm = top + np.log(np.exp(logs - top).sum(axis=0))
        share = np.exp(logs - norm)
        now = float((norm * weights).sum() / total)
        if abs(now - before) < tolerance:
            break
        before = now
    return Mixture(tuple((mass / mass.sum()).tolist()), tuple(means.tolist()), tuple(variances.tolist()))


def fit_scores(scored: DataFrame, cfg: Config = Config(), score: str = "score") -> tuple[Mixture | None, int]:
    """The mixture of a score column, or None below gmm_min_samples scores or if all are equal; and the number of scores."""
    bin_ = F.least(F.floor(F.col(score) * BINS), F.lit(BINS - 1))
    rows = scored.where(F.col(score).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("x")).orderBy("bin").collect()
    n = sum(r["n"] for r in rows)
    if n < cfg.gmm_min_samples or len(rows) < 2:
        return None, n
    return fit(np.array([r["x"] for r in rows], float), np.array([r["n"] for r in rows], float)), n


def metadata(spark, mixture: Mixture, n: int) -> DataFrame:
    schema = "weights array<double>, means array<double>, variances array<double>, high_index int, n_pairs long"
    return spark.createDataFrame([(list(mixture.weights), list(mixture.means), list(mixture.variances), mixture.high, n)], schema)
