"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centroid(total: Column, n: Column) -> Column:
    return F.transform(total, lambda s: s / n)


def variance(total: Column, squares: Column, n: Column) -> Column:
    return F.zip_with(squares, total, lambda q, s: q / n - (s / n) * (s / n))


def mahalanobis(features: Column, centre: Column, spread: Column) -> Column:
    """Distance under per-dimension variances; infinite if any variance is not positive."""
    terms = F.zip_with(
        F.zip_with(features, centre, lambda x, c: (x - c) * (x - c)), spread, lambda d, v: F.try_divide(d, v)
    )
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(F.exists(spread, lambda v: v <= 0), F.lit(float("inf"))).otherwise(F.sqrt(total))
