"""The vector index against scoring everything: clusters, hot vectors, ties, unusable rows, many queries."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators.vector_index import VectorIndex


def table(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


def clusters(seed, n, size=8, centres=12, spread=0.05):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, size))
    return middle[r.integers(0, centres, n)] + r.normal(size=(n, size)) * spread


def brute(q, x, k):
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    s = unit(q) @ unit(x).T
    return [[(int(j), round(float(s[i, j]), 9)) for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 9), j))[:k]] for i in range(len(q))]


def answers(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r.place, r.vec_id, round(r.score, 9)))
    return {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in got.items()}


@pytest.mark.parametrize("part", [20_000, 37])
def test_answers_are_those_of_scoring_everything(spark, part):
    x = np.concatenate([clusters(1, 600), np.tile(clusters(2, 1), (150, 1)), np.random.default_rng(3).normal(size=(50, 8))])
    q = np.concatenate([clusters(4, 60), x[[3, 650, 651]], np.random.default_rng(5).normal(size=(20, 8))])
    index = VectorIndex(table(spark, x, "vec_id"), "vec_id", "embedding", 8, part=part)
    got = answers(index.top_k(table(spark, q, "query_id"), "query_id", 7))
    want = brute(q, x, 7)
    assert len(got) == len(q)
    for i in range(len(q)):
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=1e-9)
        if i < 60:  # without ties the rows are the same as well
            assert [v for v, s in got[i] if s > want[i][-1][1]] == [v for v, s in want[i] if s > want[i][-1][1]]


def test_bounds_spare_most_of_the_work_where_rows_cluster(spark):
    x = clusters(7, 3000, spread=0.01)
    index = VectorIndex(table(spark, x, "vec_id"), "vec_id", "embedding", 8, centres=24)
    q = table(spark, clusters(7, 3000, spread=0.01)[:40] + 0.001, "query_id")
    share = index.share_scored(q, "query_id", 5)
    assert 0 < share < 0.2


def test_bounds_hold_for_every_row(spark):
    x = np.random.default_rng(11).normal(size=(500, 6))
    index = VectorIndex(table(spark, x, "vec_id"), "vec_id", "embedding", 6, centres=9)
    q = np.random.default_rng(12).normal(size=(30, 6))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    bound = index.rings.bounds(q)
    place = {(int(c), int(r)): i for i, (c, r) in enumerate(zip(index.rings.centre, index.rings.number, strict=True))}
    for r in index.rows.collect():
        assert (q @ np.array(r.v) <= bound[:, place[r.centre, r.ring]] + 1e-9).all()


def test_few_rows_and_unusable_ones(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 2.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 1.0]), (8, None)], "query_id long, embedding array<double>")
    got = answers(VectorIndex(rows, "vec_id", "embedding", 2).top_k(queries, "query_id", 5))
    assert {q: [v for v, _ in r] for q, r in got.items()} == {9: [1, 6]}
    assert VectorIndex(rows.limit(0), "vec_id", "embedding", 2).top_k(queries, "query_id", 5).count() == 0
    assert VectorIndex(rows, "vec_id", "embedding", 2).top_k(queries.where(F.lit(False)), "query_id", 5).count() == 0
