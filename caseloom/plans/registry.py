"""Where queries are registered, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame`` under its own name."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            SQL[key] = sql
        return fn

    return add
