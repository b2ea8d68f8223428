"""Exact nearest rows by cosine without scoring every row.

Rows are assigned once to the nearest of some centres and parted by their
distance from it into rings.  The triangle inequality bounds the score that any
row of a ring can have for a query.  A query first visits the rings of best
bound that hold ``k`` rows between them; the score of its k-th row then rules
out every ring whose bound lies below, and what is left is visited as well.

Rings of many rows are cut into parts by hash, queries into parts of their own,
and a part of rows meets a part of queries in one task, so no ring, however
common its vector, is held by one task.  Centres come from a bounded sample:
they decide how much is scored, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.functions import vectors
from caseloom.sources.scratch import small_batches, stored

#: Rows that centres are drawn from, the most centres, rings to a unit of distance, and rows or queries of a part.
SAMPLE, CENTRES, RINGS, PART = 20_000, 1024, 16, 20_000
#: Numbers held at once in scores or bounds of a slice of queries, and visits of one batch.
CELLS, VISITS = 1 << 20, 10_000
#: Scores are sums of rounded products: a bound must be this much worse before it rules out a ring.
SLACK = 1e-9


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean, from every row to every centre."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None], 0))


def unit_rows(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    return df.select(F.col(key), vectors.unit(F.col(vector), dimension).alias("v")).where("v is not null")


class Rings:
    """Centres, and of each ring its centre, number of rows, and least and greatest distance from the centre."""

    def __init__(self, centres: np.ndarray, found: list):
        self.centres = centres
        self.centre, self.number, self.n = (np.array([r[c] for r in found], np.int64) for c in ("centre", "ring", "n"))
        self.low, self.high = (np.array([r[c] for r in found], float) for c in ("low", "high"))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The best score that a row of each ring can have, for every query."""
        d = distances(q, self.centres)[:, self.centre] if len(self.n) else np.zeros((len(q), 0))
        gap = np.maximum(np.maximum(d - self.high, self.low - d), 0)
        return 1 - gap**2 / 2

    def first_visits(self, bound: np.ndarray, k: int) -> np.ndarray:
        """Whether a query visits a ring at first: the best by bound, until they hold ``k`` rows."""
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        visit = np.zeros(bound.shape, bool)
        np.put_along_axis(visit, order, before < k, axis=1)
        return visit

    def parts(self, part: int) -> list[tuple[int, int, int]]:
        """Centre, ring and number of its parts."""
        return [(c, r, -(-n // part)) for c, r, n in zip(self.centre.tolist(), self.number.tolist(), self.n.tolist(), strict=True)]


class VectorIndex:
    """Rows by (centre, ring); rows without a usable vector are left out."""

    def __init__(self, rows: DataFrame, row_id: str, vector: str, dimension: int, centres: int | None = None, part: int = PART, seed: int = 7):
        self.row_id, self.vector, self.dimension, self.part = row_id, vector, dimension, part
        self.kind = dict(rows.dtypes)[row_id]
        small_batches(rows.sparkSession)
        unit = stored(unit_rows(rows, row_id, vector, dimension), "unit-rows")
        self.n_rows = unit.count()
        drawn = unit.select("v").orderBy(F.xxhash64(F.lit(seed), row_id)).limit(SAMPLE).collect()  # a bounded sample
        middle = centred(np.array([r.v for r in drawn], float).reshape(-1, dimension), centres or min(CENTRES, max(1, math.isqrt(self.n_rows))), seed)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = distances(matrix(b.column(1), dimension), middle)
                near = d.argmin(1) if len(d) else np.zeros(0, np.int64)
                far = d[np.arange(len(d)), near]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array((far * RINGS).astype(np.int32)), pa.array(far)], names=[row_id, "v", "centre", "ring", "far"])

        self.rows = stored(unit.mapInArrow(placed, f"`{row_id}` {self.kind}, v array<double>, centre int, ring int, far double"), "index-rows")
        found = self.rows.groupBy("centre", "ring").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).orderBy("centre", "ring").collect()  # at most CENTRES x 2 x RINGS
        self.rings = Rings(middle, found)

    def top_k(self, queries: DataFrame, query_id: str, k: int) -> DataFrame:
        """``query_id, row_id, score, place``: the ``k`` rows of greatest cosine, ties by row id."""
        asked = stored(unit_rows(queries, query_id, self.vector, self.dimension), "unit-queries")
        first = self.visited(asked.withColumn("least", F.lit(None).cast("double")), query_id, k)
        known = stored(best(first, query_id, self.row_id, k), "first-visits")
        least = known.groupBy(query_id).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
        later = self.visited(asked.join(least, query_id, "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), query_id, k)
        return best(known.drop("place").unionByName(later), query_id, self.row_id, k)

    def visits(self, asked: DataFrame, query_id: str, k: int) -> DataFrame:
        """``query, v, centre, ring, part`` of every ring that a query visits: the first ones where ``least`` is null, else the others that may beat it."""
        kind, rings, dimension = dict(asked.dtypes)[query_id], self.rings, self.dimension
        cells = np.array([(c, r, n) for c, r, n in rings.parts(self.part)], np.int64).reshape(-1, 3)
        step = max(1, CELLS // max(1, cells[:, 2].sum()))

        def of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            bound = rings.bounds(matrix(b.column(1), dimension))
            visit = rings.first_visits(bound, k)
            least = b.column(2).to_numpy(zero_copy_only=False)
            if not np.isnan(least).all():
                visit = ~visit & (bound >= least[:, None] - SLACK)
            at, which = np.nonzero(visit)
            times = cells[which, 2]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            take, ring = np.repeat(at, times), np.repeat(which, times)
            for i in range(0, len(take), VISITS):
                now = slice(i, i + VISITS)
                chosen = pa.array(take[now])
                yield pa.RecordBatch.from_arrays([b.column(0).take(chosen), b.column(1).take(chosen), *(pa.array(c, pa.int32()) for c in (cells[ring[now], 0], cells[ring[now], 1], part[now]))], names=[query_id, "v", "centre", "ring", "part"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    yield from of(whole.slice(at, step))

        return asked.select(query_id, "v", "least").mapInArrow(run, f"`{query_id}` {kind}, v array<double>, centre int, ring int, part int")

    def visited(self, asked: DataFrame, query_id: str, k: int) -> DataFrame:
        """The ``k`` best rows of each query in each part that it visits."""
        row_id, dimension, part = self.row_id, self.dimension, self.part
        shares = max(1, -(-asked.count() // part))
        kind = dict(asked.dtypes)[query_id]
        visits = self.visits(asked, query_id, k).withColumn("share", F.pmod(F.xxhash64(F.lit(1), query_id), F.lit(shares)).cast("int"))
        sizes = self.rows.sparkSession.createDataFrame(self.rings.parts(part), "centre int, ring int, parts int")
        rows = self.rows.join(F.broadcast(sizes), ["centre", "ring"]).withColumn("part", F.pmod(F.xxhash64(row_id), "parts").cast("int"))  # at most CENTRES x 2 x RINGS rows
        rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        cell = ["centre", "ring", "part", "share"]

        def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
            rows = rows.sort_by(row_id)
            x, q = (matrix(t["v"].combine_chunks(), dimension) for t in (rows, asked))
            at, which, scores = [], [], []
            step = max(1, CELLS // max(1, len(x)))
            for i in range(0, len(q) if len(x) else 0, step):
                s = q[i : i + step] @ x.T
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                at.append(np.repeat(np.arange(i, i + len(s)), top.shape[1]))
                which.append(top.ravel())
                scores.append(np.take_along_axis(s, top, 1).ravel())
            at, which, scores = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (at, which, scores))
            return pa.Table.from_arrays([asked[query_id].take(pa.array(at)), rows[row_id].take(pa.array(which)), pa.array(scores, pa.float64())], names=[query_id, row_id, "score"])

        return rows.select(*cell, row_id, "v").groupBy(*cell).cogroup(visits.groupBy(*cell)).applyInArrow(score, f"`{query_id}` {kind}, `{row_id}` {self.kind}, score double")

    def share_scored(self, queries: DataFrame, query_id: str, k: int) -> float:
        """Rows scored over rows times queries: what the bounds leave of the work."""
        asked = stored(unit_rows(queries, query_id, self.vector, self.dimension), "unit-queries")
        first = self.top_k(queries, query_id, k).groupBy(query_id).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
        sizes = self.rows.sparkSession.createDataFrame(self.rings.parts(1), "centre int, ring int, n long")
        both = self.visits(asked.withColumn("least", F.lit(None).cast("double")), query_id, k).unionByName(self.visits(asked.join(first, query_id), query_id, k))
        scored = both.where("part = 0").join(F.broadcast(sizes), ["centre", "ring"]).agg(F.sum("n")).first()[0] or 0
        return scored / max(1, self.n_rows * asked.count())


def centred(sample: np.ndarray, k: int, seed: int, rounds: int = 5) -> np.ndarray:
    """Centres of a sample by a few rounds of k-means."""
    k = min(k, len(sample))
    centres = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)] if k else sample
    for _ in range(rounds if k else 0):
        near = distances(sample, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def best(found: DataFrame, query_id: str, row_id: str, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), row_id))
    return found.withColumn("place", place).where(F.col("place") <= k)
