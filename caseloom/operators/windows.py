"""Ranks, running budgets and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.operators.running import Fold, folded, running_total


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def reciprocal_rank_fusion(lists: dict[str, DataFrame], key: str, score: str, per: list[str], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists that hold a row; ranks by score, ties by key."""
    order = W.partitionBy(*per).orderBy(F.desc(score), key)
    parts = [df.select(*per, key, (1 / (k + F.row_number().over(order))).alias("__s")) for df in lists.values()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*per, key).agg(F.sum("__s").alias("fused"))


def budgeted_prefix(rows: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int, slices: int | None = None) -> DataFrame:
    """Rows in ascending order while their costs fit together; the first overflow ends the list."""
    return running_total(rows, keys, order, F.col(cost), "used", slices).where(F.col("used") <= budget)


def batches(rows: DataFrame, order: list[Column], size: int, per: list[str], slices: int | None = None) -> DataFrame:
    """Numbers of fixed-size batches within each group, rows in ascending order."""
    return running_total(rows, per, order, F.lit(1), "batch", slices).withColumn("batch", F.floor((F.col("batch") - 1) / size))


def purge_size(total: Column, incoming: Column, capacity: int = 10_000, buffer: int = 100) -> Column:
    """Rows to purge before ``incoming`` more arrive; nothing while they fit."""
    overflow = total + incoming - capacity
    return F.when(overflow > 0, F.greatest(overflow, F.when(incoming > buffer, incoming + buffer).otherwise(F.lit(buffer)))).otherwise(F.lit(0))


def length_buckets(rows: DataFrame, key: Column, length: str, chunk: int) -> DataFrame:
    """Chunks of hash-ordered rows of a group; the longest first within each."""
    spread = rows.withColumn("chunk", F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(chunk)))
    return spread.withColumn("place", F.row_number().over(W.partitionBy("chunk").orderBy(F.desc(length), key)))


class Average(Fold):
    """Exponential moving average over (order, value); state is whether it has begun, and its value.

    A stretch turns a value a into decay * a + sum, or begins an average of its own.
    """

    def __init__(self, alpha: float):
        self.alpha = alpha

    def start(self) -> list:
        return [False, None]

    def step(self, state: list, at: object, x: float | None) -> tuple[list, tuple]:
        begun, a = state
        a = x if not begun else None if a is None or x is None else self.alpha * x + (1 - self.alpha) * a
        return [True, a], (at, a)

    def nothing(self) -> list:
        return [1.0, 0.0, self.start()]

    def extend(self, held: list, at: object, x: float | None) -> list:
        decay, total, own = held
        gone = decay is None or x is None
        return [None if gone else decay * (1 - self.alpha), None if gone else self.alpha * x + (1 - self.alpha) * total, self.step(own, at, x)[0]]

    def apply(self, summary: list, state: list) -> list:
        decay, total, own = summary
        begun, a = state
        return own if not begun else [True, None if a is None or decay is None else decay * a + total]


def running_average(rows: DataFrame, key: str, order: str, value: str, alpha: float, slices: int | None = None) -> DataFrame:
    """The moving average after each row; no key's rows are one task's."""
    types = dict(rows.dtypes)
    flat = rows.withColumn(value, F.col(value).cast("double"))
    return folded(flat, key, [order, value], Average(alpha), f"`{key}` {types[key]}, `{order}` {types[order]}, average double", each=True, slices=slices)
