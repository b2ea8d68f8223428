"""Counts, rates and comparisons for reports and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(hit: Column, into: str) -> list[Column]:
    """value, hit and total of a condition over a group; the value is null for an empty group."""
    hits = F.sum(hit.cast("long"))
    return [F.round(hits / F.nullif(F.count(hit), F.lit(0)), 4).alias(f"{into}_value"), F.coalesce(hits, F.lit(0)).alias(f"{into}_hit"), F.count(hit).alias(f"{into}_total")]


def percentage(done: Column, total: Column, status: Column) -> Column:
    """100 only when completed; otherwise the floor, between 0 and 99."""
    share = F.coalesce(F.floor(100 * done / F.nullif(total, F.lit(0))), F.lit(0))
    return F.when(status == "completed", F.lit(100)).otherwise(F.greatest(F.lit(0), F.least(F.lit(99), share))).cast("long")


def confusion(rows: DataFrame, expected: str, got: str) -> DataFrame:
    return rows.where(~F.col(expected).eqNullSafe(F.col(got))).groupBy(expected, got).agg(F.count("*").alias("n")).orderBy(F.desc("n"), expected, got)


def before_after(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both values and the change in points; a side may lack a key."""
    b, a = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return b.join(a, keys, "full").withColumn("points", F.round(100 * (F.col("after") - F.col("before")), 2))


def mean_vector(rows: DataFrame, key: str, vector: str, into: str) -> DataFrame:
    """The mean of the vectors of each key, position by position; partial sums before the shuffle."""
    each = rows.select(key, F.posexplode(vector).alias("__i", "__x"))
    means = each.groupBy(key, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(into))


def wide_by(rows: DataFrame, index: str, name: str, value: str, names: list[str]) -> DataFrame:
    return rows.groupBy(index).pivot(name, names).agg(F.max(value))


def joined_reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in pairs])), "; ")
