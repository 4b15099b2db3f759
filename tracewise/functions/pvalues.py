"""Two-sided p-values from test statistics, for the one row that each comparison ends in."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Sizes up to which the null of the rank-sum test is counted out, if there are no ties; and of the signed-rank test.
EXACT_RANK_SUM, EXACT_SIGNED_RANK = 8, 50


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * value


def student_p(t: float, freedom: float) -> float:
    """Of a t statistic."""
    if math.isnan(t) or not freedom > 0:
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def normal_p(z: float) -> float:
    """Of a standard normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2))


def pearson_p(r: float, n: int) -> float:
    """Of a correlation of n points."""
    if n < 3 or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    return student_p(r * math.sqrt((n - 2) / ((1 - r) * (1 + r))), n - 2)


@lru_cache(maxsize=256)
def _rank_sum_counts(n: int, m: int) -> np.ndarray:
    """Number of orders of n and m values for each U."""
    counts = np.zeros(n * m + 1)
    counts[0] = 1.0
    # The generating function is a quotient of products of (1 - x^i).
    for i in range(1, n + 1):
        up, down = m + i, i
        for u in range(n * m, up - 1, -1):
            counts[u] -= counts[u - up]
        for u in range(down, n * m + 1):
            counts[u] += counts[u - down]
    return counts


def rank_sum_p(u: float, n: int, m: int, tie_sum: float) -> float:
    """Of the first sample's U; ``tie_sum`` is the sum of t^3 - t over groups of tied values.

    Exact if a sample has ``EXACT_RANK_SUM`` values at most and nothing is tied, else normal with corrections for ties
    and continuity.
    """
    if not n or not m:
        return math.nan
    high = max(u, n * m - u)
    if tie_sum == 0 and min(n, m) <= EXACT_RANK_SUM:
        counts = _rank_sum_counts(min(n, m), max(n, m))
        return min(1.0, 2 * float(counts[math.ceil(high) :].sum() / counts.sum()))
    all_ = n + m
    spread = math.sqrt(n * m / 12 * (all_ + 1 - tie_sum / (all_ * (all_ - 1))))
    return min(1.0, normal_p((high - n * m / 2 - 0.5) / spread)) if spread else 1.0


@lru_cache(maxsize=256)
def _signed_rank_counts(n: int) -> np.ndarray:
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for i in range(1, n + 1):
        counts[i:] = counts[i:] + counts[: len(counts) - i].copy()
    return counts


def signed_rank_p(w: float, n: int, zeros: int, tie_sum: float) -> float:
    """Of the smaller signed rank sum of n differences other than zero.

    Exact for up to ``EXACT_SIGNED_RANK`` differences without ties and zeros, else normal with a correction for ties.
    """
    if not n:
        return math.nan
    if n <= EXACT_SIGNED_RANK and not zeros and tie_sum == 0:
        counts = _signed_rank_counts(n)
        return min(1.0, 2 * float(counts[: int(w) + 1].sum() / counts.sum()))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48)
    return normal_p((w - n * (n + 1) / 4) / spread) if spread else 1.0
