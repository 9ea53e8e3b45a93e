"""Vector arithmetic on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(a: Column) -> Column:
    return a.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 where the lengths differ or a vector is null."""
    same = (F.size(a) == F.size(b)) & a.isNotNull() & b.isNotNull()
    return F.coalesce(F.when(same, _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))), F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ, a vector is null or empty, or a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(F.coalesce(scale, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(scale != 0, scale))


def l2_normalized(a: Column) -> Column:
    """The vector divided by its norm; a zero vector as it is."""
    n = norm(a)
    return F.when(n == 0, _doubles(a)).otherwise(F.transform(_doubles(a), lambda x: x / F.when(n != 0, n)))
