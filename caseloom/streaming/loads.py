"""Incremental loads as Structured Streaming: each micro-batch commits once, restarts skip what is committed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources.scratch import exists, stored
from caseloom.streaming.history import BUCKETS, FAN_OUT, HASH, History


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def load_new(stream: DataFrame, target: str, checkpoint: str, content: str, order: str, buckets: int = BUCKETS, fan_out: int = FAN_OUT) -> None:
    """Append rows whose content neither the target nor an earlier row of the batch has; run to the end of what is there.

    A batch writes a folder named after its number, so a batch that runs again
    after a failure replaces what it had written.  What was loaded before is
    asked from a :class:`History` beside the rows (a folder that readers of the
    target pass over), bucket by bucket.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        history = History(spark, f"{target}/_history", buckets, fan_out)
        first = batch.withColumn(HASH, F.sha2(content, 256)).groupBy(HASH).agg(F.min(F.struct(order, *[c for c in batch.columns if c != order])).alias("m")).select(HASH, "m.*")
        written = f"{target}/load={number}"
        # rows without a content have no hash: the first of each batch is kept
        history.unseen(stored(first, "batch"), number).write.mode("overwrite").parquet(written)
        history.add(spark.read.parquet(written).where(F.col(HASH).isNotNull()), number)

    run_to_end(stream, checkpoint, commit)


def retain(stream: DataFrame, target: str, checkpoint: str, order: list[str], capacity: int = 10_000, buffer: int = 100) -> None:
    """Keep at most ``capacity`` rows: a batch makes room among the rows that are there, the newest first, before it is added.

    One writer, one version of the table for each batch: ``version=n`` follows
    from the last version before ``n``, so a batch that runs again after a
    failure gives the same rows again.  A batch that is itself too large loses
    its newest rows, and leaves ``buffer`` places free.  No version ever holds
    more than ``capacity`` rows, so one is small whatever the stream's length.
    """
    oldest = [F.col(c).asc() for c in order]

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = stored(batch, "batch")
        incoming, last = batch.count(), latest_version(spark, target, number)
        rows, total = batch.limit(0), 0
        if last is not None:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/version={last}")
            total = rows.count()
        overflow = total + incoming - capacity
        if overflow > 0:
            purged = max(overflow, incoming + buffer if incoming > buffer else buffer)
            rows = rows.orderBy(*oldest).limit(max(0, total - purged))
            total = max(0, total - purged)
        rows, total = rows.unionByName(batch), total + incoming
        if total > capacity:
            rows = rows.orderBy(*oldest).limit(max(0, capacity - buffer))
        rows.write.mode("overwrite").parquet(f"{target}/version={number}")

    run_to_end(stream, checkpoint, commit)


def latest_version(spark: SparkSession, target: str, before: int | None = None) -> int | None:
    """The last complete version of a table made by :func:`retain`."""
    if not exists(spark, target):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath() for x in fs.listStatus(path(target))]
    found = [int(n.getName().removeprefix("version=")) for n in names if n.getName().startswith("version=") and fs.exists(path(n, "_SUCCESS"))]
    return max((x for x in found if before is None or x < before), default=None)


def retained(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/version={latest_version(spark, target)}")


def run_to_end(stream: DataFrame, checkpoint: str, commit: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """First rows of their keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
