"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def dense(axes: Column, names: list[str]) -> Column:
    """Values of a map in the order of ``names``; missing axes are 0."""
    return F.array(*[F.coalesce(axes[n], F.lit(0.0)) for n in names])


def usable(a: Column) -> Column:
    """True for a vector that is present and not all zero."""
    return a.isNotNull() & F.exists(F.coalesce(a, F.array().cast("array<double>")), lambda x: x != 0)


def weighted_mean(vectors: Column, weights: Column, size: int) -> Column:
    """Mean of an array of vectors with the given weights, axis by axis; null without weight."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    axis = lambda i: F.aggregate(F.zip_with(vectors, weights, lambda v, w: F.get(v, F.lit(i)).cast("double") * w), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.array(*[axis(i) / total for i in range(size)]))
