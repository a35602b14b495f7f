"""Histogram arithmetic on one column's values in memory, by the rules of operators.stats."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

#: (cumulative rows, lower, upper, rows of the upper value), in ascending order.
Bucket = tuple[int, int, int, int]


def build(values: np.ndarray, buckets: int = 10) -> list[Bucket]:
    """Values belong to the first bucket while fewer than total / buckets rows come before; each further value is its own."""
    v, n = np.unique(np.asarray(values), return_counts=True)
    upto = np.cumsum(n)
    if not len(v):
        return []
    first = int(np.count_nonzero((upto - n) * buckets < upto[-1]))
    out = [(int(upto[first - 1]), int(v[0]), int(v[first - 1]), int(n[first - 1]))]
    return out + [(int(u), int(x), int(x), int(k)) for u, x, k in zip(upto[first:], v[first:], n[first:], strict=True)]


def less_rows(buckets: list[Bucket], v: float) -> float:
    """Estimated rows below v."""
    i = bisect_left([b[2] for b in buckets], v)
    before = buckets[i - 1][0] if i else 0
    if i == len(buckets):
        return float(before)
    count, lower, upper, repeats = buckets[i]
    if v < lower:
        return float(before)
    if v == upper:
        return float(count - repeats)
    share = (v - lower) / (upper - lower) if upper > lower else 0.5
    return before + share * (count - repeats - before)


def between_rows(buckets: list[Bucket], low: float, high: float, ndv: int) -> float:
    """Estimated rows in [low, high)."""
    if not buckets:
        return 0.0
    lo, hi, total = less_rows(buckets, low), less_rows(buckets, high), buckets[-1][0]
    return min(hi, total - lo, total / ndv) if lo >= hi and ndv > 0 else hi - lo
