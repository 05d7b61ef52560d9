"""Array arithmetic in double precision, summed from the first element on: equal inputs, equal bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2_normalize(a: Column, floor: float = 1e-12) -> Column:
    return F.transform(a, lambda v: v.cast("double") / F.greatest(norm(a), F.lit(floor)))


def linear(a: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """W a + b for a small literal matrix."""
    return F.array(*[F.lit(b) + dot(a, F.array(*[F.lit(float(w)) for w in row])) for row, b in zip(weights, bias, strict=True)])
