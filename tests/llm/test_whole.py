"""Whole inputs: rows that ids do not tell apart, and a benchmark of several blocks."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm import common, decontaminate, packing, simhash, substrings
from tests.test_whole import words


def test_near_dedup_keeps_texts_that_ids_do_not_tell_apart(spark, tmp_path):
    a, b, c = words(11, 40), words(12, 40), words(13, 40)
    docs = spark.createDataFrame([(None, a), (None, a), (1, b), (1, c), (1, c), (2, b)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.stage(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(None, a), (None, a), (1, b), (1, c)], key=repr)


def test_blocks_of_the_benchmark_come_one_at_a_time(spark, monkeypatch):
    seen, blocks, stored = [], decontaminate.blocks, decontaminate.stored

    def watched(*a):
        for b in blocks(*a):
            seen.append("drawn")
            yield b

    monkeypatch.setattr(decontaminate, "blocks", watched)
    monkeypatch.setattr(decontaminate, "stored", lambda *a: seen.append("stored") or stored(*a))
    items = spark.createDataFrame([(i, words(20 + i, 14)) for i in range(3)], "item_id long, text string")
    docs = spark.createDataFrame([(i, words(20 + i, 14)) for i in range(4)], "doc_id long, text string")
    for pass_bytes, want in ((1, ["drawn", "drawn", "drawn", "stored", "stored"]), (1 << 20, ["drawn"] * 3)):
        seen.clear()
        got = {r.doc_id: r["__hit"]["items"] for r in decontaminate.scanned(docs, items, max_words=1, pass_bytes=pass_bytes).collect()}
        assert got == {0: ["0"], 1: ["1"], 2: ["2"], 3: []}
        assert sorted(seen) == want


def test_a_large_benchmark_takes_one_pass(spark, tmp_path, monkeypatch):
    """20 MB of benchmark: every document is read once, and the planted passages are found in all blocks."""
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 1 << 20)
    n, long = 20_000, 160
    ids = spark.range(n, numPartitions=8)
    items = ids.select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(long)), lambda x: F.concat(F.lit("w"), F.hex(F.pmod(F.xxhash64("id", x), F.lit(40_000))))), " ").alias("text"))
    items.write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    assert items.agg(F.sum(F.length("text"))).first()[0] > 15 << 20
    passage = F.array_join(F.slice(F.split("text", " "), 41, 20), " ")
    planted = items.where("item_id % 1000 = 7").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), passage, F.lit(" and after")).alias("text"))
    clean = items.where("item_id % 1000 = 8").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before it "), F.array_join(F.slice(F.split("text", " "), 41, 12), " "), F.lit(" and after")).alias("text"))
    planted.union(clean).coalesce(2).write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(decontaminate, "stored", lambda *a: pytest.fail("a second pass"))
    got = decontaminate.scanned(spark.read.parquet(str(tmp_path / "docs")), items).collect()
    assert len(got) == 40
    for r in got:
        h = r["__hit"]
        assert (h.n_hit, h["items"]) == ((20, [str(r.doc_id)]) if r.doc_id % 1000 == 7 else (0, [])), r.doc_id


LETTERS = st.lists(st.sampled_from("abc"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=6), st.lists(LETTERS, max_size=3), st.integers(1, 9), st.integers(1, 40), st.integers(0, 3))
def test_windows_are_found_as_by_comparing_all(items, docs, width, most, surroundings):
    """Few different words, so that stretches repeat, overlap and have many surroundings; items in parts and in blocks."""
    named = [(str(i), " ".join(x)) for i, x in enumerate(items)]

    class Rows:
        def select(self, *_):
            return self

        def toLocalIterator(self):
            return iter([SimpleNamespace(i=i, t=t.encode()) for i, t in named])

    before, decontaminate.SURROUNDINGS = decontaminate.SURROUNDINGS, surroundings
    try:
        benchmark = decontaminate.Benchmark(list(decontaminate.blocks(Rows(), "i", "t", width, most)), width)
        got = benchmark.hits([" ".join(d).encode() for d in docs])
    finally:
        decontaminate.SURROUNDINGS = before
    for doc, found in zip(docs, got, strict=True):
        covered, owners = set(), set()
        for i, own in enumerate(items):
            for k in range(max(1, len(own) - width + 1) if own else 0):
                w = own[k : k + width]
                for at in range(len(doc) - len(w) + 1):
                    if doc[at : at + len(w)] == w:
                        covered |= set(range(at, at + len(w)))
                        owners.add(str(i))
        assert {x for a, n, _ in found for x in range(a, a + n)} == covered
        assert {x for h in found for x in h[2]} == owners


EXACT = Tokenizer.from_file(packing.default_vocabulary())


def exact(text):
    return EXACT.encode(text, add_special_tokens=False).ids


def test_ids_of_all_documents_are_those_of_the_vocabulary_s_own_library():
    encoder = packing.Encoder(packing.default_vocabulary())
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    assert len(texts) >= 1000
    assert [t[:80] for t in texts if encoder.ids(t or "") != exact(t or "")] == []


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(["<|endoftext|>", "'s", "'LL", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\u200b", "1", "\u0661", "\u00b2", "e\u0301", "\ud55c", "\U0001f600", "a", "."]), max_size=30).map("".join)))
def test_ids_of_any_text_are_those_of_the_vocabulary_s_own_library(text):
    assert packing.Encoder.of(packing.default_vocabulary()).ids(text) == exact(text)


def test_columns_of_any_name_come_along(spark):
    items = spark.createDataFrame([(i, words(40 + i, 14)) for i in range(3)], "item_id long, text string")
    docs = spark.createDataFrame([(i, words(40 + i, 14), "mine", "too") for i in range(4)], "doc_id long, text string, __found0 string, __found2 string")
    got = decontaminate.scanned(docs, items, max_words=1, pass_bytes=1)
    assert got.columns == [*docs.columns, "__hit"]
    assert {r.doc_id: (r["__found0"], r["__found2"], r["__hit"]["items"]) for r in got.collect()} == {0: ("mine", "too", ["0"]), 1: ("mine", "too", ["1"]), 2: ("mine", "too", ["2"]), 3: ("mine", "too", [])}
    with pytest.raises(ValueError, match="__hit"):
        decontaminate.scanned(docs.withColumnRenamed("__found0", "__hit"), items)


def test_a_batch_of_lower_ids_is_refused(spark, tmp_path):
    text = words(50, 60)
    rows = lambda *ids: spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")
    index = substrings.SubstringIndex(spark, str(tmp_path / "index"), 4)
    index.add(rows(10))
    with pytest.raises(ValueError, match="up to 10: a batch with document 5"):
        index.add(rows(5, 12))
    again = substrings.SubstringIndex.open(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError, match="up to 10"):
        again.add(rows(10))
    _, starts = again.add(rows(11))
    assert [r.doc_id for r in starts.collect()] == [11] and substrings.SubstringIndex.open(spark, str(tmp_path / "index")).last == 11


def test_only_hot_keys_are_salted_and_copied(spark, monkeypatch):
    """One key has a third of all rows; every row finds its partner once, and cold keys keep one row each."""
    monkeypatch.setattr(common, "HOT", 10)
    left = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k % 5 <> 1").withColumn("name", F.concat(F.lit("n"), "k"))
    joined = common.salted_left(left, right, "k", "doc_id", "n")
    assert sorted(joined.columns) == ["doc_id", "k", "name"]
    got = {r.doc_id: (r.k, r.name) for r in joined.collect()}
    assert joined.count() == len(got) == 3000
    assert all(name == (None if k % 5 == 1 else f"n{k}") for k, name in got.values())
    shuffled = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in shuffled}
    try:
        for k, v in shuffled.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in common.salted_left(left, right, "k", "doc_id", "n").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) < 700  # a third of all rows alone would be 1,000
