"""The pipeline's stages on rows with awkward cases: columns stay, decisions take effect, clean documents stay."""

from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.test_operators import ROWS, SCHEMA, empty, folder, hits  # noqa: F401

EXPECTED = ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]


def test_stages_in_order(spark, folder):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == EXPECTED
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in ROWS}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == SCHEMA.names
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        assert now <= kept
        if name == "quality_rules":
            assert all(len((r.text or "").split()) >= 20 for r in rows) and len(now) < len(kept)
        if name == "simhash_near_dedup":
            assert len(rows) == len(now) and 2000 not in now
        docs = spark.createDataFrame(rows, docs.schema)
        kept = now
    assert 1013 not in kept
    assert len(kept) > 30


def test_run_packs_what_is_kept(spark, folder):  # noqa: F811
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_an_empty_table_packs_nothing(spark, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_null_columns_do_not_break_a_stage(spark, folder, name, stage):  # noqa: F811
    docs = spark.createDataFrame([(None, None, None, None, None, None, None), (1, None, None, None, None, None, None), (2, "", "en", "s", 1, "x", 0)], spark.read.parquet(f"{folder}/documents.parquet").schema)
    assert stage(spark, docs, folder).columns == SCHEMA.names
    assert stage(spark, docs, folder).count() <= 3
