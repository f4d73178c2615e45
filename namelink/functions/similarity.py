"""Character and token similarity scores, 0 to 100 (Indel based), and their Arrow-batched functions."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; a's positions are bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    return 200.0 * lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer, also cut off at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))
    if len(a) == len(b):
        best = max(best, *(ratio(b, a[max(0, i) : i + len(b)]) for i in range(1 - len(b), len(a))))
    return best


def _sets(a: str, b: str) -> tuple[set[str], set[str]]:
    return set(a.split()), set(b.split())


def _spaced(tokens: set[str]) -> str:
    return " ".join(sorted(tokens))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = _sets(a, b)
    if not x or not y:
        return 0.0
    both, only_a, only_b = x & y, _spaced(x - y), _spaced(y - x)
    if both and (not only_a or not only_b):
        return 100.0
    shared = len(_spaced(both))
    gap = 1 if shared else 0
    total_a, total_b = shared + gap + len(only_a), shared + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * lcs(only_a, only_b)
    scores = [100 * (1 - apart / (total_a + total_b))]
    if shared:
        scores += [100 * (1 - (gap + len(only_a)) / (shared + total_a)), 100 * (1 - (gap + len(only_b)) / (shared + total_b))]
    return max(scores)


def token_ratio(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def partial_token_ratio(a: str, b: str) -> float:
    x, y = _sets(a, b)
    if x & y:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(_spaced(x), _spaced(y)))


@lru_cache(maxsize=100_000)
def wratio(a: str, b: str) -> float:
    """Weighted best of the ratios; partial ones come in, scaled down, when the lengths differ by half or more."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


_PAIR = StructType([StructField("wratio", DoubleType()), StructField("token_set", DoubleType())])


@F.pandas_udf(_PAIR)
def text_scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """WRatio and token_set_ratio of normalised names, one Arrow batch at a time."""
    pairs = list(zip(a.fillna(""), b.fillna("")))
    return pd.DataFrame({"wratio": [wratio(x, y) for x, y in pairs], "token_set": [token_set_ratio(x, y) for x, y in pairs]})


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a.fillna(""), b.fillna(""))], dtype="float64")
