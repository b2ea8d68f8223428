"""A history of content hashes that a load asks only where it has to.

The history is a folder of immutable runs, each the hashes of some loads, dealt
into buckets by their leading bits and sorted inside.  A batch reads the
buckets its own hashes fall into and merges with those; its cost follows the
batch and the buckets it touches, not the history.  Runs are merged in the
background of later loads, so their number stays small.

A run is named by its first and last load and counts only when complete.
Batch ``n`` sees runs that end before ``n``: a batch that runs again after a
failure never meets its own hashes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.sources.scratch import brief_shuffles

BUCKETS = 256
#: Runs that may lie beside one another before they are merged.
FAN_OUT = 8
HASH = "__h"
NAME = re.compile(r"run=(\d+)-(\d+)$")


class History:
    """Hashes (lower-case hex) of all that was loaded, in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fan_out: int = FAN_OUT):
        self.spark, self.path, self.buckets, self.fan_out = spark, path, buckets, fan_out
        self.jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self, of: Column | str = HASH) -> Column:
        return (F.conv(F.substring(of, 1, 8), 16, 10).cast("long") % self.buckets).cast("int")

    def runs(self, before: int) -> list[tuple[int, int]]:
        """Complete runs that end before load ``before``; none of them lies inside another."""
        root = self.jvm_path(self.path)
        if not self.fs.exists(root):
            return []
        found = []
        for status in self.fs.listStatus(root):
            name = NAME.search(status.getPath().toString())
            if name and self.fs.exists(self.jvm_path(status.getPath(), "_SUCCESS")):
                found.append(tuple(map(int, name.groups())))
        found = [r for r in found if r[1] < before]
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run={run[0]}-{run[1]}"

    def read(self, before: int, buckets: list[int] | None = None) -> DataFrame | None:
        """Hashes of the loads before one, of all buckets or some: other buckets' files are not opened."""
        runs = self.runs(before)
        if not runs:
            return None
        out = None
        for r in runs:
            run = self.spark.read.schema(f"{HASH} string, bucket int").parquet(self.folder(r))
            run = run if buckets is None else run.where(F.col("bucket").isin(buckets))
            out = run if out is None else out.unionByName(run)
        return out

    def unseen(self, batch: DataFrame, load: int) -> DataFrame:
        """Rows of ``batch`` (with distinct hashes in ``__h``) whose hash no earlier load has."""
        touched = [r.b for r in batch.select(self.bucket().alias("b")).distinct().collect() if r.b is not None]  # at most ``buckets`` numbers
        past = self.read(load, touched)
        return batch if past is None else batch.join(past.select(HASH), HASH, "left_anti")

    def add(self, hashes: DataFrame, load: int) -> None:
        """Write the run of one load, in place of what an earlier attempt left; merge earlier runs if there are many."""
        self.write(hashes.select(HASH), (load, load))
        runs = self.runs(load)
        if len(runs) > self.fan_out:
            self.write(self.read(load).select(HASH), (runs[0][0], runs[-1][1]))
            for r in runs:
                self.fs.delete(self.jvm_path(self.folder(r)), True)

    def write(self, hashes: DataFrame, run: tuple[int, int]) -> None:
        dealt = hashes.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", HASH)
        with brief_shuffles(self.spark):
            dealt.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(self.folder(run))
