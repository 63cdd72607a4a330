"""Vector expressions over ``array<float>`` columns, evaluated in double precision inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where either is null or the lengths differ."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Null for zero vectors, where the angle is undefined. ``norm_b`` is the length of ``b``, if known."""
    return F.try_divide(dot(a, b), norm(a) * (norm(b) if norm_b is None else norm_b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def cosine_with_epsilon(a: Column, b: Column, epsilon: float = 1e-10) -> Column:
    """Similarity whose denominator is kept above zero: zero vectors score 0."""
    return dot(a, b) / (norm(a) * norm(b) + epsilon)


def l2_normalize(v: Column) -> Column:
    """The vector scaled to length 1; elements null for a zero vector."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.try_divide(x, n))


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


def has_dim(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def searchable(v: Column, dim: int) -> Column:
    """True for vectors that have a direction: right length, no null or NaN, not all zero."""
    return F.coalesce(v.isNotNull() & has_dim(v, dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & ~is_zero(v), F.lit(False))


def validity(v: Column, dim: int) -> Column:
    """``missing``, ``wrong_dimension``, ``nan``, ``zero`` or ``ok``."""
    return F.when(v.isNull(), "missing").when(~has_dim(v, dim), "wrong_dimension").when(has_nan(v), "nan").when(is_zero(v), "zero").otherwise("ok")
