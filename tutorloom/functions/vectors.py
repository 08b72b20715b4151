"""Vector arithmetic on ``array<float|double>`` columns, without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(F.try_divide(dot(a, b), length))


def unit(a: Column) -> Column:
    """The vector scaled to length 1 (unchanged when it is zero)."""
    length = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: F.when(length == 0, x).otherwise(F.try_divide(x, length)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
