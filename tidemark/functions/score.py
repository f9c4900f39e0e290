"""Similarity of two split paths, and tests against a catalog's mean score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(a: Column, b: Column) -> Column:
    """Weighted prefix match of two arrays of path segments.

    With n segments in common length, segment p (from 0) of which k of at most L leading characters agree adds
    (n - p) * (k * L - k * (k - 1) / 2): early segments and early characters weigh most.
    """
    n = F.least(F.size(a), F.size(b))

    def of(p: Column) -> Column:
        x, y = F.get(a, p), F.get(b, p)
        most = F.least(F.length(x), F.length(y))
        k = F.size(F.filter(F.sequence(F.lit(1), most), lambda c: F.left(x, c) == F.left(y, c))).cast("long")
        return (n - p) * (k * most - F.floor(k * (k - 1) / 2))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0).cast("long"), lambda s, p: s + of(p))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(total)


def above_mean(score: Column, n: Column, total: Column) -> Column:
    """score > mean of n scores, in whole numbers."""
    return score * n > total


def above_share_of_mean(score: Column, n: Column, total: Column, numerator: int = 4, denominator: int = 5) -> Column:
    """score > numerator / denominator * mean, in whole numbers."""
    return score * n * denominator > total * numerator


def z_score(score: Column, mean: Column, deviation: Column) -> Column:
    """Standard score; null where all are equal."""
    return (score - mean) / F.nullif(deviation, F.lit(0.0))
