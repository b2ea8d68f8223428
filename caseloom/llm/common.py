"""What the training-data operators share: intermediate tables, Arrow maps, components.

Intermediate results go to the folder named by ``spark.checkpoint.dir``, so a
lost executor costs a re-read and never a re-run of the lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseloom.sources.scratch import brief_shuffles, folder, small_batches, stored

__all__ = ["brief_shuffles", "folder", "small_batches", "stored"]

#: A key is hot if it has more than one part in so many of all rows.
HOT = 4096
#: ASCII white space: what parts words in every contract here.
SPACES = b"\t\n\x0b\x0c\r "
#: Lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bucketed(df: DataFrame, key: str, buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """``df`` stored in the shared folder, bucketed and sorted by ``key``: later joins on it do not move it.

    ``dealt``: it lies in ``buckets`` partitions by ``key`` already.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"t_{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`stored` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, schema: str | T.StructType, fn: Callable[[pa.RecordBatch], Iterator[dict | pa.RecordBatch]]) -> DataFrame:
    """``fn`` turns one Arrow batch into column dicts (or batches) of ``schema``."""
    small_batches(df.sparkSession)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                yield out

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, text: str, added: str, fn: Callable[[list[bytes]], list[list]]) -> DataFrame:
    """Keep every column of ``df`` and append ``added``, which ``fn`` computes from the UTF-8 texts.

    A null text counts as empty.  ``added`` must not name a column of ``df``.
    """
    small_batches(df.sparkSession)
    extra = T.StructType.fromDDL(added)
    schema = T.StructType([*df.schema.fields, *extra.fields])
    kinds = [f.type for f in to_arrow_schema(extra)]
    at = df.columns.index(text)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            arrays = [pa.array(x, kind) for x, kind in zip(fn(texts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return df.mapInArrow(run, schema)


def salted_left(left: DataFrame, right: DataFrame, on: str, by: str, count: str, salts: int = 16) -> DataFrame:
    """Left join with hot keys: ``right`` has one row per key of ``left``, with the number ``count`` of its rows there.

    A key with more than a ``HOT`` th of all rows is hot, so fewer than ``HOT`` keys are, and their
    list may be broadcast.  Their rows are spread over ``salts`` by the column ``by``, and they alone are copied.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > total / HOT
    hot = F.broadcast(right.where(is_hot).select(on, F.lit(True).alias("__hot")))
    spread = left.join(hot, on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0)))).drop(count)
    return spread.join(copies, [on, "__salt"], "left").drop("__salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u long, v long)``: ``node, root`` with the least node as root.

    Alternating large-star and small-star steps; every round is written to the
    shared folder.  Only counts reach the driver.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = stored(pairs, "edges")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = stored(small, "edges")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components: no fixed point within {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def digest_of_list(items: Column) -> Column:
    """Lower-case hex SHA-256 of a comma-joined list."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
