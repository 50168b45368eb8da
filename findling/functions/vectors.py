"""Vector distances as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(_doubles(a), lambda x: x * x)))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos``; null when either vector has no length."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(_total(gaps))
