"""Similarities of two array columns, for pairs that already sit on one row.

Comparing many queries with many targets goes through operators/pairs.py instead.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from inkprint.functions.arrays import bind


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot_score(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    return bind(F.struct(a.alias("v"), norm(a).alias("size")), lambda s: F.transform(
        s["v"], lambda x: F.when(s["size"] > 0, x.cast("double") / s["size"]).otherwise(F.lit(0.0))))


def cosine_distance(a: Column, b: Column) -> Column:
    sizes = norm(a) * norm(b)
    return F.lit(1.0) - F.when(sizes > 0, dot_score(a, b) / sizes).otherwise(F.lit(0.0))


def angular_score(a: Column, b: Column) -> Column:
    """1 - angle / pi for unit vectors; the dot product is clipped to [-1, 1]."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot_score(a, b)))
    return F.lit(1.0) - F.acos(clipped) / F.pi()


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


DISTANCES = {
    "cosine": cosine_distance,
    "euclidean": euclidean,
    "manhattan": manhattan,
    "chebyshev": chebyshev,
}


def metric_distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in DISTANCES:
        raise ValueError(f"unsupported metric {metric!r}; choose one of {sorted(DISTANCES)}")
    return DISTANCES[metric](a, b)
