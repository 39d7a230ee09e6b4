"""Geometry on arrays of doubles, in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def masked_rms(a: Column, b: Column) -> Column:
    """Root mean square difference over places that are null on neither side; null without any."""
    d = F.filter(F.zip_with(a, b, lambda x, y: x - y), lambda v: v.isNotNull())
    return F.sqrt(F.try_divide(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v), F.size(d).cast("double")))
