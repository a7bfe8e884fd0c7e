"""Expressions over array columns taken as vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def unit(v: Column | str) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine_distance(a, b) -> Column:
    """1 - x.y of the unit vectors."""
    return 1 - dot(a, b) / (norm(a) * norm(b))


def euclidean_distance(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def manhattan_distance(a, b) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean_distance, "manhattan": manhattan_distance}
