"""Vector and spectral functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, guard: float = 1e-10) -> Column:
    """v / (|v| + guard), so a zero vector stays zero."""
    return F.transform(F.array(norm(v) + guard), lambda n: F.transform(doubles(v), lambda x: x / n))[0]


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def gaussian_kernel(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-squared_distance(a, b) / (2 * sigma * sigma))


def position_weight(slot: Column, slots: int) -> Column:
    """Weight of a context slot: 0.4 at the oldest, 1 at the newest."""
    return 0.4 + 0.6 * slot / (slots - 1)


def ridge_factor(mu: Column, ridge: float) -> Column:
    return mu / (mu + ridge)


def iteration_factor(mu: Column, steps: Column) -> Column:
    return 1 - F.pow(1 - mu, steps)
