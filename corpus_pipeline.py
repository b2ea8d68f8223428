"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before it kept.  The first four return
the columns of ``documents``; the last returns the pieces of the sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import decontaminate, lines, packing, quality, simhash
from caseloom.llm.common import stored

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("packing", packing.stage),
]

#: The hashes, automata and token ids of the stages are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
