"""Tables that steps leave for later steps, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


#: Rows in one Arrow batch; texts are long, so a batch stays at some megabytes.
BATCH_ROWS = 1000
#: And this many bytes, a last row aside.
BATCH_BYTES = 16 << 20


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset on a single machine, as in tests, a temporary one of the application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/caseloom-{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, and the path in it; Hadoop's names for S3 are known too."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the file system that Spark takes it to be on, for those who open it without Spark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked of its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when the query ends; what it wrote stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage."""
    path = folder(df.sparkSession, name)
    with brief_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, as whole texts are long; the session keeps these bounds."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
