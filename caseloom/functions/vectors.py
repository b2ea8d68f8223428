"""Vector checks, norms and similarities, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def usable(v: Column, dimension: int) -> Column:
    """Of the right length, finite throughout, and not zero."""
    finite = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite & (norm(v) > 0), F.lit(False))


def unit(v: Column, dimension: int) -> Column:
    """The vector over its norm; null where it is not usable."""
    return F.when(usable(v, dimension), F.transform(doubles(v), lambda x: x / norm(v)))


def held_back(v: Column, dimension: int) -> Column:
    """A warning for a vector that is kept out while its row stays."""
    return F.when(v.isNull(), F.lit(None).cast("string")).when(F.size(v) != dimension, F.concat(F.lit("dimension "), F.size(v).cast("string")))


def text_form(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))
