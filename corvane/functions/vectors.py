"""Dense-vector expressions over ``array<double>`` columns (no Python involved)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12  # norms below this leave a zero row zero


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(vector: Column) -> Column:
    size = F.greatest(norm(vector), F.lit(TINY))
    return F.transform(vector, lambda x: x / size)


def truncate(vector: Column, dim: int) -> Column:
    """The first ``dim`` components, re-normalised (a Matryoshka prefix)."""
    return normalize(F.slice(vector, 1, dim))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; a zero vector scores 0."""
    size = norm(left) * norm(right)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(left, right) / size)
