"""Vector functions on array<double> or array<float> columns; sums are double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length; zero and empty vectors stay as they are."""
    m = magnitude(a)
    return F.when(m > 0, F.transform(a, lambda x: x.cast("double") / m)).otherwise(F.transform(a, lambda x: x.cast("double")))


def is_normalized(a: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(magnitude(a) - 1.0) <= tolerance


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    m = magnitude(a) * magnitude(b)
    return F.when(m > 0, dot(a, b) / m).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def scaled(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * k)


def blended(a: Column, b: Column, weight_a: float = 0.6, weight_b: float = 0.4) -> Column:
    """Weighted sum of a text's and an image's vector, at unit length."""
    return normalized(add(scaled(a, weight_a), scaled(b, weight_b)))
