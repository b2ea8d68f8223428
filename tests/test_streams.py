"""State by key, the history of hashes, and retention in a load: timers, restarts, batches that run again."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from caseloom.streaming import history, loads, state


def beats(spark, folder, rows):
    df = spark.createDataFrame(rows, "k string, sec long").select("k", F.timestamp_seconds("sec").alias("ts"))
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def told(spark, source, schema, target, progress, seconds):
    stream = loads.file_stream(spark, source, schema, 1)
    state.run_keyed(state.stale_stream(stream, "k", "ts", seconds), progress, lambda b, i: b.write.mode("overwrite").parquet(f"{target}/load={i}"))
    return sorted((r.k, r.kind, r.beat, r.back) for r in spark.read.schema("k string, kind string, beat long, back long").parquet(target).collect())


def test_timers_tell_silences_and_restarts_go_on(spark, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    schema = beats(spark, source, [("a", 100), ("b", 100), ("a", 110)])
    assert told(spark, source, schema, target, progress, 50) == []
    beats(spark, source, [("a", 155), (None, 155)])  # b is silent for 55 s, a for 45 s
    first = told(spark, source, schema, target, progress, 50)
    assert first == [("b", "stale", 100, None)]
    # a new query on the same checkpoint: b comes back, a was silent inside the batch, c stays silent
    beats(spark, source, [("b", 190), ("a", 300), ("c", 160), ("a", 290)])
    beats(spark, source, [(None, 400)])
    got = told(spark, source, schema, target, progress, 50)
    assert got == sorted([*first, ("b", "back", 100, 190), ("a", "stale", 155, None), ("a", "back", 155, 290), ("b", "stale", 190, None), ("c", "stale", 160, None), ("a", "stale", 300, None)])
    assert told(spark, source, schema, target, progress, 50) == got  # nothing new, nothing again


def test_silences_do_not_depend_on_the_cut_into_batches(spark, tmp_path):
    r = random.Random(8)
    rows = sorted(((r.choice("abcd"), r.randrange(5000)) for _ in range(120)), key=lambda x: x[1])
    want = set()
    for k in "abcd":
        mine = sorted({s for x, s in rows if x == k}) + [9000]
        want |= {(k, a, b) for a, b in zip(mine, mine[1:], strict=False) if b - a > 200}
    for cut in (7, 60):
        source, target, progress = (str(tmp_path / f"{x}{cut}") for x in ("in", "out", "progress"))
        for i in range(0, len(rows), cut * 2):
            schema = beats(spark, source, rows[i : i + cut * 2])
        beats(spark, source, [(None, 9000)])
        got = told(spark, source, schema, target, progress, 200)
        back = {(k, beat, b) for k, kind, beat, b in got if kind == "back"}
        open_ = {(k, beat, 9000) for k, kind, beat, _ in got if kind == "stale"} - {(k, beat, 9000) for k, beat, _ in back}
        assert back | open_ == want and len(got) == len(set(got))


def test_breakers_forget_keys_when_their_time_is_over(spark, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    calls = [("a", 0, 100, True), ("a", 1, 120, False), ("b", 2, 130, True)]
    later = [("a", 3, 159, True), ("a", 4, 160, False), ("b", 5, 300, True), ("b", 6, 301, True)]
    got = {}
    for rows in (calls, later):
        df = spark.createDataFrame(rows, "k string, id long, sec long, bad boolean").select("k", "id", "bad", F.timestamp_seconds("sec").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        out = state.breaker_stream(loads.file_stream(spark, source, df.schema, 1), "k", "id", "ts", "bad", 60)
        state.run_keyed(out, progress, lambda b, i: b.write.mode("overwrite").parquet(f"{target}/load={i}"))
        got = {x.id: x.outcome for x in spark.read.parquet(target).collect()}
    assert got == {0: "failed", 1: "skipped", 2: "failed", 3: "skipped", 4: "ok", 5: "failed", 6: "skipped"}
    with state.keyed_state(spark):
        left = spark.read.format("statestore").option("path", progress).option("stateVarName", "until").load()
        assert [r.key.k for r in left.collect()] == ["b"]


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(state.PROVIDER)
    with state.keyed_state(spark):
        assert spark.conf.get(state.PROVIDER) == state.ROCKS
    assert spark.conf.get(state.PROVIDER) == before


# the history of hashes


def hashes(spark, names):
    return spark.createDataFrame([(hashlib.sha256(str(x).encode()).hexdigest(), x) for x in names], "__h string, name long")


def test_a_batch_reads_only_the_buckets_it_touches(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"), buckets=64, fan_out=3)
    h.add(hashes(spark, range(5000)), 0)
    batch = hashes(spark, [3, 70_000])
    touched = [r.b for r in batch.select(h.bucket().alias("b")).distinct().collect()]
    read, whole = h.read(1, touched), h.read(1)
    assert len(touched) == 2 and whole.count() == 5000
    assert 0 < read.count() < 300  # two buckets of 64
    scanned = [m for m in read._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in m]
    assert scanned and all("bucket" in m.split("PartitionFilters:")[1] for m in scanned)
    assert [r.name for r in h.unseen(batch, 1).collect()] == [70_000]


def test_runs_are_merged_and_a_load_never_meets_itself(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"), buckets=4, fan_out=3)
    for i in range(9):
        batch = hashes(spark, range(i * 10, i * 10 + 12))  # two rows of each load come again in the next
        assert sorted(r.name for r in h.unseen(batch, i).collect()) == list(range(i * 10 + (2 if i else 0), i * 10 + 12))
        h.add(batch, i)
        assert len(h.runs(i + 1)) <= 5
        assert h.unseen(batch, i).count() == (10 if i else 12)  # the same load once more
        h.add(batch, i)
    assert h.read(9).select("__h").distinct().count() == 92
    assert any(lo != hi for lo, hi in h.runs(9))


def test_runs_without_an_end_do_not_count(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"), buckets=4)
    h.add(hashes(spark, range(5)), 0)
    h.add(hashes(spark, range(5, 9)), 1)
    (tmp_path / "h" / "run=1-1" / "_SUCCESS").unlink()
    assert h.runs(5) == [(0, 0)] and h.read(5).count() == 5


class Killed(RuntimeError):
    pass


@pytest.mark.parametrize("where", ["add", "unseen"])
def test_a_killed_load_is_loaded_once(spark, tmp_path, monkeypatch, where):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    texts = ["a", "b", "a", None, "c", "d", "b", "e", "c", "f", "a"]
    for i, t in enumerate(texts):
        spark.createDataFrame([(i, t)], "id long, text string").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: loads.file_stream(spark, source, spark.read.parquet(source).schema, 2)
    real, seen = getattr(history.History, where), []

    def dies(self, *a):
        seen.append(1)
        if len(seen) == 3:
            if where == "add":
                real(self, *a)  # the run is written, the checkpoint isn't
            raise Killed
        return real(self, *a)

    monkeypatch.setattr(history.History, where, dies)
    with pytest.raises(Exception, match="Killed"):
        loads.load_new(stream(), target, progress, "text", "id", buckets=4, fan_out=2)
    loads.load_new(stream(), target, progress, "text", "id", buckets=4, fan_out=2)
    got = [r.text for r in spark.read.parquet(target).collect()]
    assert sorted(map(str, got)) == ["None", "a", "b", "c", "d", "e", "f"]


# retention


def retained(capacity, buffer, batches):
    """The table after each batch, by the rule."""
    rows, out = [], []
    for b in batches:
        over = len(rows) + len(b) - capacity
        if over > 0:
            rows = rows[: max(0, len(rows) - max(over, len(b) + buffer if len(b) > buffer else buffer))]
        rows = sorted(rows + b)
        rows = rows[: capacity - buffer] if len(rows) > capacity else rows
        out.append(rows)
    return out


def test_no_version_is_ever_above_capacity(spark, tmp_path, monkeypatch):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    r = random.Random(3)
    ids = list(range(400))
    r.shuffle(ids)
    batches = [sorted(ids[a:b]) for a, b in ((0, 30), (30, 55), (55, 60), (60, 61), (61, 200), (200, 230), (230, 231))]
    for b in batches:
        spark.createDataFrame([(x, str(x)) for x in b], "id long, text string").coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stored, seen = loads.stored, []

    def dies(df, name):
        seen.append(1)
        if len(seen) in (3, 6):
            raise Killed
        return stored(df, name)

    monkeypatch.setattr(loads, "stored", dies)
    for _ in range(3):
        try:
            loads.retain(loads.file_stream(spark, source, schema, 1), target, progress, ["id"], 60, 5)
        except Exception as e:  # noqa: BLE001  the query was killed and starts again
            assert "Killed" in str(e)
        sizes = [spark.read.parquet(str(p)).count() for p in (tmp_path / "out").glob("version=*")]
        assert sizes and max(sizes) <= 60
    want = retained(60, 5, batches)
    got = [sorted(r.id for r in spark.read.parquet(f"{target}/version={i}").collect()) for i in range(len(batches))]
    assert got == want and loads.latest_version(spark, target) == len(batches) - 1
    assert sorted(r.id for r in loads.retained(spark, target).collect()) == want[-1]
