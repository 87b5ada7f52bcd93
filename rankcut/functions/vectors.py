"""Vector arithmetic as Column expressions; doubles throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """x / (|x| + 1e-8)."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + 1e-8))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))


def fits(a: Column, dim: int) -> Column:
    """Whether a vector has this many components, none of them NULL."""
    return (F.size(a) == dim) & ~F.exists(a, lambda x: x.isNull())
