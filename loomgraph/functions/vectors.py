"""Dense vector expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalize(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    # As a lambda's argument the length is computed once, not for every component.
    return F.get(F.transform(F.array(norm(a)), lambda size: F.transform(a.cast("array<double>"), lambda x: F.when(size > 0, x / size).otherwise(x))), F.lit(0))


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """The offline default embedder: counts of hashed tokens, at length 1."""
    spots = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(spots, lambda s: s == i)).cast("double"))
    return counts
