"""Embedder and model calls: batches, breakers, rows that fail by themselves, restarts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from caseloom.operators import models


def lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


def rows(spark, texts, partitions=1):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(partitions)


def test_a_failure_in_the_middle_holds_back_the_rest_of_the_task(spark):
    def fails(texts):
        if any("x30" in t for t in texts):
            raise ConnectionError("service is down")
        return lengths(texts)

    df = spark.createDataFrame([(i, f"x{i}") for i in range(60)], "id long, text string").coalesce(1)
    got = {r.id: r for r in models.embed(df, "text", fails, 2, unit=False, call_bytes=1).collect()}
    assert len(got) == 60
    assert [got[i].embedding for i in range(30)] == [[float(len(f"x{i}")), 1.0] for i in range(30)]
    late = {i: r for i, r in got.items() if r.embedding is None}
    assert set(range(30, 60)) == set(late) and {r.embedding_warning for r in late.values()} == {"held back after a failure: ConnectionError: service is down"}


def test_each_task_has_a_breaker_of_its_own(spark):
    def fails(texts):
        if any(t == "bad" for t in texts):
            raise TimeoutError("too slow")
        return lengths(texts)

    df = spark.createDataFrame([(i, "bad" if i == 0 else f"x{i}") for i in range(40)], "id long, text string").repartitionByRange(4, "id")
    got = {r.id: r.embedding for r in models.embed(df, "text", fails, 2, call_bytes=1).collect()}
    assert sum(v is None for v in got.values()) == 10 and all(got[i] for i in range(12, 40))


def test_what_is_wrong_with_one_row_stays_with_it(spark):
    def picky(texts):
        for t in texts:
            if t == "overlong":
                raise models.RowError("HTTP 413")
        return [{"short": [1.0], "nan": [float("nan"), 1.0], "zero": [0.0, 0.0], "none": None}.get(t, [3.0, 4.0]) for t in texts]

    texts = ["good", "overlong", "short", "nan", "zero", "none", "good after", "", "  ", None]
    got = {r.id: (r.embedding, r.embedding_warning) for r in models.embed(rows(spark, texts), "text", picky, 2).collect()}
    assert got[0] == got[6] == ([0.6, 0.8], None)
    assert [got[i][1] for i in (1, 2, 3, 4, 5)] == ["HTTP 413", "dimension 1 instead of 2", "not all components are finite", "all components are zero", "no vector was returned"]
    assert got[7] == got[8] == got[9] == (None, None)


def test_calls_are_bounded_by_bytes_and_equal_texts_share_one(spark):
    calls, sent = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(texts):
        calls.add(1)
        sent.add(len(texts))
        assert len(texts) == 1 or sum(len(t.encode()) for t in texts) <= 20
        return lengths(texts)

    texts = ["0123456789" + str(i % 10) for i in range(50)] + ["y" * 100]
    got = models.embed(rows(spark, texts), "text", counting, 2, call_bytes=20).collect()
    assert len(got) == 51 and all(r.embedding for r in got) and sent.value == 11 and calls.value == 11


def test_breakers_close_again_after_their_cooldown():
    now = [0.0]
    b = models.Breaker(30, lambda: now[0])
    fn = lambda texts: 1 / 0 if now[0] < 10 else ["fine"] * len(texts)
    assert models.called(fn, ["a"], b)[0][0] is None and b.open()
    now[0] = 29.0
    assert models.called(fn, ["a"], b) == [(None, "held back after a failure: ZeroDivisionError: division by zero")]
    now[0] = 31.0
    assert models.called(fn, ["a"], b) == [("fine", None)]


def test_a_service_that_answers_too_few_is_a_failure():
    assert models.called(lambda texts: ["one"], ["a", "b"], models.Breaker())[1] == (None, "held back after a failure: ValueError: 2 texts gave 1 results")


def test_every_column_stays_and_names_must_not_clash(spark):
    df = spark.createDataFrame([(1, "a", [1, 2], {"k": 1})], "id long, text string, l array<int>, m map<string,int>")
    assert models.embed(df, "text", lengths, 2).select(df.columns).collect() == df.collect()
    assert models.embed(df.limit(0), "text", lengths, 2).count() == 0
    with pytest.raises(ValueError, match="exist already"):
        models.embed(df.withColumn("embedding", F.lit(1)), "text", lengths, 2)


def answers(texts):
    return [json.dumps({"category": "a", "summary": f"of {t}", "urgency": "high"}) for t in texts]


def test_a_restart_calls_only_what_was_not_committed(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def service(down):
        def fn(texts):
            calls.add(len(texts))
            if down and any(t in down for t in texts):
                raise ConnectionError("down")
            return answers(texts)

        return fn

    texts = [f"text {i % 30}" for i in range(90)] + ["gated out", "", None]
    df = rows(spark, texts, 3).withColumn("want", F.col("text") != "gated out")
    store = str(tmp_path / "answers")
    got = models.apply_model(df, "text", F.col("want"), service({"text 7"}), store, slices=4, call_bytes=1).collect()
    failed = {r.text for r in got if r.outcome == "failed"}
    assert len(got) == 93 and sum(r.outcome == "skipped" for r in got) == 3 and "text 7" in failed
    assert all(r.why.startswith("held back after a failure") for r in got if r.outcome == "failed")
    first = calls.value
    assert first <= 30
    got = models.apply_model(df, "text", F.col("want"), service(set()), store, slices=4).collect()
    assert calls.value - first == len(failed) and {r.outcome for r in got if r.want} == {"ok", "skipped"}
    done = calls.value
    got = models.apply_model(df, "text", F.col("want"), service(set()), store).collect()
    assert calls.value == done and sum(r.outcome == "ok" for r in got) == 90
    assert {json.loads(r.answer)["summary"] for r in got if r.answer} == {f"of text {i}" for i in range(30)}


def test_a_job_that_dies_keeps_the_slices_it_committed(spark, tmp_path, monkeypatch):
    calls, done = spark.sparkContext.accumulator(0), []
    df = rows(spark, [f"text {i}" for i in range(40)])
    store, stored = str(tmp_path / "answers"), models.stored

    def dying(frame, name):
        if name == "answers":
            done.append(name)
            if len(done) == 3:
                raise RuntimeError("killed")
        return stored(frame, name)

    def fn(texts):
        calls.add(len(texts))
        return answers(texts)

    monkeypatch.setattr(models, "stored", dying)
    with pytest.raises(RuntimeError, match="killed"):
        models.apply_model(df, "text", F.lit(True), fn, store, slices=4)
    before = calls.value
    assert 0 < before < 40
    monkeypatch.setattr(models, "stored", stored)
    got = models.apply_model(df, "text", F.lit(True), fn, store, slices=4).collect()
    assert calls.value == 40 and {r.outcome for r in got} == {"ok"}


def test_answers_are_checked_before_they_stand(spark):
    said = [("ok", '{"category": "a", "summary": "s", "urgency": "high"}'), ("ok", '{"category": "zzz", "summary": "s"}'), ("ok", '{"category": "a", "summary": " "}'), ("ok", "nonsense"), ("failed", None), ("skipped", None), ("ok", '```json\n{"category": "b", "summary": "t", "urgency": "?"}\n```')]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(said)], "id int, outcome string, answer string").withColumn("rule", F.struct(F.lit("r").alias("category")))
    got = [r.d for r in df.select("id", models.decided(F.col("rule"), F.col("answer"), F.col("outcome"), ["a", "b"]).alias("d")).orderBy("id").collect()]
    assert [(x.category, x.evidence, x.urgency) for x in got] == [
        ("a", "model", "high"), *[("r", "rule after an invalid answer", "medium")] * 3, ("r", "rule after failure", "medium"), ("r", "rule", "medium"), ("b", "model", "medium")]
