"""Running sums and folds over slices: one key with half of all rows, any cut, and the same rows as one after another."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.operators import lifecycle, running, windows


def rows(seed, n):
    """Rows of a hot key (half of them), of some others and of none, in a shuffled order."""
    r = random.Random(seed)
    out = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i, r.choice([None, 1, 2, 5, 40]), r.random() < 0.3, r.choice(["in progress", "done", "received", "cancelled", None, "lost"])) for i in range(n)]
    r.shuffle(out)
    return out


SCHEMA = "k string, id long, cost long, bad boolean, wanted string"


def by_key(data):
    held = defaultdict(list)
    for row in sorted(data, key=lambda x: x[1]):
        held[row[0]].append(row)
    return held


@pytest.mark.parametrize("slices", [1, 3, 12])
def test_running_totals(spark, slices):
    data = rows(1, 700)
    df = spark.createDataFrame(data, SCHEMA)
    got = {(x.k, x.id): x.used for x in running.running_total(df, ["k"], [F.col("id")], F.col("cost"), "used", slices).collect()}
    want = {}
    for k, mine in by_key(data).items():
        total = None
        for x in mine:
            total = total if x[2] is None else (total or 0) + x[2]
            want[k, x[1]] = total
    assert got == want
    kept = {(x.k, x.id) for x in windows.budgeted_prefix(df, ["k"], [F.col("id")], "cost", 90, slices).collect()}
    assert kept == {x for x, used in want.items() if used is not None and used <= 90}
    numbers = {(x.k, x.id): x.batch for x in windows.batches(df, [F.col("id")], 7, ["k"], slices).collect()}
    assert numbers == {(k, x[1]): i // 7 for k, mine in by_key(data).items() for i, x in enumerate(mine)}


def test_every_column_stays_and_none_are_no_rows(spark):
    df = spark.createDataFrame([("a", 2, [1], {"x": 1}), ("a", 1, [2], {})], "k string, id long, l array<int>, __cost map<string,int>")
    got = running.running_total(df, ["k"], [F.col("id")], F.lit(1), "place", 2)
    assert got.columns == [*df.columns, "place"] and sorted((x.id, x.place) for x in got.collect()) == [(1, 1), (2, 2)]
    assert running.running_total(df.limit(0), ["k"], [F.col("id")], F.lit(1), "place", 2).count() == 0


def test_a_key_with_half_of_all_rows_lies_in_half_of_the_slices(spark):
    df = spark.createDataFrame(rows(2, 4000), SCHEMA)
    sizes = {x[running.SLICE]: x["count"] for x in running.sliced(df, ["k"], ["id"], 16).groupBy(running.SLICE).count().collect()}
    hot = running.sliced(df, ["k"], ["id"], 16).where("k = 'hot'").select(running.SLICE).distinct().count()
    assert len(sizes) >= 14 and hot >= 7 and max(sizes.values()) < 3 * 4000 / 16


@pytest.mark.parametrize("slices", [1, 4, 15])
def test_folds_over_slices(spark, slices):
    data = rows(3, 600)
    df = spark.createDataFrame(data, SCHEMA).withColumn("v", F.col("cost").cast("double"))
    average = {(x.k, x.id): x.average for x in windows.running_average(df.withColumn("v", F.coalesce("v", F.lit(0.5))), "k", "id", "v", 0.3, slices).collect()}
    outcome = {(x.k, x.id): x.outcome for x in lifecycle.with_breaker(df, "id", F.col("bad"), "k", "id", 9, slices).collect()}
    state = {x.k: (x.state, x.rejected) for x in lifecycle.fold(df, "k", "id", "wanted", slices=slices).collect()}
    want_average, want_outcome, want_state = {}, {}, {}
    for k, mine in by_key(data).items():
        a, until, now, rejected = None, -1, "received", 0
        for _, i, cost, bad, wanted in mine:
            v = 0.5 if cost is None else float(cost)
            a = v if a is None else 0.3 * v + 0.7 * a
            want_average[k, i] = a
            want_outcome[k, i] = "skipped" if i < until else "failed" if bad else "ok"
            until = i + 9 if want_outcome[k, i] == "failed" else until
            now, rejected = (wanted, rejected) if wanted in lifecycle.MOVES[now] else (now, rejected + 1)
        want_state[k] = (now, rejected)
    assert outcome == want_outcome and state == want_state
    assert average.keys() == want_average.keys() and all(abs(average[x] - want_average[x]) < 1e-9 for x in average)


def test_an_average_that_meets_null_stays_null(spark):
    df = spark.createDataFrame([("a", i, None if i == 5 else 1.0) for i in range(12)] + [("b", 0, None), ("b", 1, 2.0)], "k string, id long, v double")
    for slices in (1, 6):
        got = {(x.k, x.id): x.average for x in windows.running_average(df, "k", "id", "v", 0.5, slices).collect()}
        assert {x for x, a in got.items() if a is None} == {("a", i) for i in range(5, 12)} | {("b", 0), ("b", 1)}


def one_by_one(fold, values):
    state, out = fold.start(), []
    for v in values:
        state, o = fold.step(state, *v)
        out.append(o)
    return state, out


def in_stretches(fold, values, cuts):
    state, at = fold.start(), 0
    for cut in [*sorted(cuts), len(values)]:
        held = fold.nothing()
        for v in values[at:cut]:
            held = fold.extend(held, *v)
        state, at = fold.apply(fold.summary(held), state), max(at, cut)
    return state


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.booleans()), max_size=30), st.lists(st.integers(0, 30), max_size=4), st.integers(1, 12))
def test_stretches_of_calls_compose(calls, cuts, seconds):
    values = [(at, i, bad) for i, (at, bad) in enumerate(sorted(calls))]
    fold = lifecycle.Breaker(seconds)
    assert in_stretches(fold, values, [c for c in cuts if c <= len(values)]) == one_by_one(fold, values)[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["in progress", "done", "received", "cancelled", "lost", None]), max_size=30), st.lists(st.integers(0, 30), max_size=4))
def test_stretches_of_events_compose(events, cuts):
    values = list(enumerate(events))
    fold = lifecycle.Status("received", lifecycle.MOVES)
    assert in_stretches(fold, values, [c for c in cuts if c <= len(values)]) == one_by_one(fold, values)[0]
