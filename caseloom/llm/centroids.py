"""Centroid clustering over a VA-file: few bits a component decide most assignments.

Vectors become integers, floor(64 x).  Each dimension is cut into 64 cells
at quantiles of all its components, and a vector's cells are packed into 6
bits each, three sixteenths of the floats.  For every centroid two small
tables, by dimension and cell, hold the least and the greatest squared
difference, less that from the centroids' mean, which is the same for all;
summed over the dimensions they bound each distance from both sides.  A vector
whose least upper bound lies below all other lower bounds is decided; only the
others, and those that change their cluster, are fetched in full.

The first assignment needs every vector once for the sums.  Later rounds carry
``row, cells, cluster``, 60 bytes a vector, decide on those, join what has to
be fetched with the vectors, which lie bucketed by row, and correct the sums by
the vectors that moved.  The last assignment fetches all, as distances are
asked for, but measures one centroid where the bounds leave one.

All sums are exact integers; only centroids and per-cluster sums (``k`` times
``dims`` numbers) reach the driver.

Defined cases.  A vector with a null, a NaN, an infinity or another number of
components is left out.  Repeated rows are vectors of their own.  Starts that
tie in their hash (equal ids) follow the order of their components; rows with a
null id are clustered but start nothing.  Fewer vectors than ``k`` give as many
centroids; none give no rows.  Equal distances go to the smaller number, an
empty cluster keeps its centroid.  A component of 2**27 or more in size after
the scaling ends the job with a clear error, as a distance would not fit a
long.  Columns beside id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import bucketed, discard, map_rows, stored, table

DIMS = 64
K = 16
ROUNDS = 3
SEED = 1
SCALE = 64
#: Bits of a cell's number.
BITS = 6
#: Components beyond this would overflow a long distance.
LARGEST = 1 << 27
#: Shares of a dimension's components below each cut: the outer cells, which reach to the extremes, take 1 in 200 each.
CUTS = tuple(0.005 + 0.99 * i / (2**BITS - 2) for i in range(2**BITS - 1))


def integers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = DIMS) -> DataFrame:
    """``row, vec_id, v`` of the vectors that are kept."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = (F.size(vector) == dims) & ~F.exists(vector, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    small = F.forall("x", lambda c: F.abs(c * SCALE) < LARGEST)
    return (
        df.where(whole)
        .select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
        .select("vec_id", F.when(small, F.transform("x", lambda c: F.floor(c * SCALE).cast("int"))).otherwise(F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more has no long distance"))).alias("v"))
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    )


def spread(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts, least and greatest component of every dimension, from all vectors; results don't depend on where the cuts lie."""
    at = [f(F.col("v")[d]) for d in range(dims) for f in (F.min, F.max, lambda c: F.percentile_approx(c, list(CUTS), 1000))]
    got = vectors.agg(*(a.alias(f"a{i}") for i, a in enumerate(at))).first()
    return np.array(got[2::3], np.int64), np.array(got[0::3], np.int64), np.array(got[1::3], np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


class Cells:
    """The cuts of every dimension, and its cells, each with the least and greatest integer in it."""

    def __init__(self, cuts: np.ndarray, least: np.ndarray, greatest: np.ndarray):
        self.cuts = cuts
        edge = np.concatenate((least[:, None], self.cuts, greatest[:, None] + 1), axis=1).astype(np.int64)
        # cell c holds cut c <= x < cut c + 1; the outer ones reach to the extremes
        self.low, self.high = edge[:, :-1], edge[:, 1:] - 1

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[d], v[:, d], side="right") for d in range(v.shape[1])], axis=1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest excess of the squared difference by dimension, cell and centroid.

        Excess over the squared difference from the centroids' mean ``m``: that
        of a component x is (x - c)**2 - (x - m)**2, linear in x, so the ends of
        the cell bound it, and more closely than they bound the difference.
        """
        c, m = centroids.T[:, None, :], (centroids.sum(0) // max(1, len(centroids)))[:, None, None]
        ends = [c * c - m * m - 2 * x[:, :, None] * (c - m) for x in (self.low, np.maximum(self.low, self.high))]
        return np.minimum(*ends), np.maximum(*ends)

    def candidates(self, cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """For every vector and centroid: may it be the nearest, as far as the cells tell?"""
        least, most = self.tables(centroids)
        low, high = (np.zeros((len(cells), len(centroids)), np.int64) for _ in range(2))
        for d in range(cells.shape[1]):
            low += least[d][cells[:, d]]
            high += most[d][cells[:, d]]
        return low <= high.min(1, keepdims=True)


def packed(cells: np.ndarray) -> np.ndarray:
    """Each vector's cells in BITS bits each."""
    bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - BITS :]
    return np.packbits(bits.reshape(len(cells), -1), axis=1)


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    bytes_ = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    bits = np.unpackbits(bytes_, axis=1)[:, : dims * BITS].reshape(len(column), dims, BITS)
    return np.packbits(bits, axis=2)[:, :, 0] >> (8 - BITS)


def nearest(v: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid among those that may be it."""
    best = np.full(len(v), np.iinfo(np.int64).max)
    who = np.zeros(len(v), np.int32)
    for k, c in enumerate(centroids):
        at = np.flatnonzero(may[:, k])
        d = ((v[at] - c) ** 2).sum(1)
        near = d < best[at]
        best[at[near]], who[at[near]] = d[near], k
    return who, best


def sums_of(cluster: np.ndarray, v: np.ndarray, sign: int, k: int) -> list[dict]:
    """What some vectors add to (or take from) their clusters."""
    out = []
    for c in np.unique(cluster[(cluster >= 0) & (cluster < k)]):
        at = v[cluster == c]
        out.append({"cluster": int(c), "n": sign * len(at), "sums": (sign * at.sum(0)).tolist()})
    return out


STATE = "row bigint, cells binary, cluster int"
MOVED = f"{STATE}, n bigint, sums array<bigint>"


def state_and_sums(rows: pa.Array, cells: pa.Array, cluster: np.ndarray, sums: list[dict]) -> dict:
    """Rows with their clusters, followed by rows (without a number) that hold sums."""
    n, m = len(rows), len(sums)
    return {
        "row": pa.concat_arrays([rows, pa.nulls(m, pa.int64())]), "cells": pa.concat_arrays([cells, pa.nulls(m, pa.binary())]),
        "cluster": [*cluster.tolist(), *(s["cluster"] for s in sums)], "n": [None] * n + [s["n"] for s in sums], "sums": [None] * n + [s["sums"] for s in sums],
    }


def added_up(moved: DataFrame, k: int, dims: int) -> tuple[list[int], list[list[int]]]:
    """Numbers and sums of all clusters: ``k`` rows of ``dims`` exact integers."""
    n, sums = [0] * k, [[0] * dims for _ in range(k)]
    rows = moved.where("row is null").select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    for r in rows.collect():
        n[r.cluster], sums[r.cluster][r.pos] = int(r.n), int(r.s)
    return n, sums


def clusters(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    spark = df.sparkSession
    vectors = stored(integers(df, vec_id, vector, dims), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = vectors.where("vec_id is not null").select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    centroids = np.array([r.v for r in starts], np.int64).reshape(-1, dims)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    file = Cells(*spread(vectors, dims))

    def celled(batch: pa.RecordBatch) -> Iterator[dict]:
        cells = packed(file.of(matrix(batch.column(2), dims)))
        yield {"row": batch.column(0), "vec_id": batch.column(1), "v": batch.column(2), "cells": [x.tobytes() for x in cells]}

    whole = bucketed(map_rows(vectors.select("row", "vec_id", "v"), "row bigint, vec_id bigint, v array<int>, cells binary", celled), "row")
    discard(vectors)

    def first(batch: pa.RecordBatch) -> Iterator[dict]:
        v = matrix(batch.column(2), dims)
        cluster, _ = nearest(v, file.candidates(unpacked(batch.column(1), dims), centroids), centroids)
        yield state_and_sums(batch.column(0), batch.column(1), cluster, sums_of(cluster, v, 1, k))

    state = stored(map_rows(whole.select("row", "cells", "v"), MOVED, first), "assigned") if rounds else None
    n, sums = added_up(state, k, dims) if rounds else (None, None)
    for later in range(rounds):
        centroids = np.array([[s // n[c] for s in sums[c]] if n[c] else centroids[c].tolist() for c in range(k)], np.int64)
        if later == rounds - 1:
            break
        state, before = moved_on(state, whole, file, centroids, dims), state
        discard(before)
        more, change = added_up(state, k, dims)
        n, sums = [a + b for a, b in zip(n, more, strict=True)], [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, change, strict=True)]
    final = centroids

    def last(batch: pa.RecordBatch) -> Iterator[dict]:
        cluster, distance = nearest(matrix(batch.column(2), dims), file.candidates(unpacked(batch.column(1), dims), final), final)
        yield {"vec_id": batch.column(0), "cluster": cluster, "distance": distance}

    out = stored(map_rows(whole.select("vec_id", "cells", "v"), "vec_id bigint, cluster int, distance bigint", last), "clusters")
    if state is not None:
        discard(state)
    drop(whole)
    by = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    inertia = {r.cluster: int(r.s) for r in by}
    digest = F.sha2(F.lit("").cast("binary"), 256)
    of_cluster = F.lit(None).cast("long")
    for c in inertia:
        digest = F.when(F.col("cluster") == c, F.sha2(F.lit(",".join(map(str, final[c].tolist()))).cast("binary"), 256)).otherwise(digest)
        of_cluster = F.when(F.col("cluster") == c, F.lit(inertia[c]).cast("long")).otherwise(of_cluster)
    return out.select("vec_id", "cluster", "distance", of_cluster.alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"))


def moved_on(state: DataFrame, whole: DataFrame, file: Cells, centroids: np.ndarray, dims: int) -> DataFrame:
    """One round from the cells: fetched are vectors whose bounds overlap and those decided for another cluster."""
    k = len(centroids)

    def judge(batch: pa.RecordBatch) -> Iterator[dict]:
        may = file.candidates(unpacked(batch.column(1), dims), centroids)
        was = batch.column(2).to_numpy()
        one = may.argmax(1)
        stays = (may.sum(1) == 1) & (one == was)
        yield {"row": batch.column(0), "cells": batch.column(1), "cluster": was, "fetch": ~stays}

    judged = map_rows(state.where("row is not null").select("row", "cells", "cluster"), f"{STATE}, fetch boolean", judge)
    judged = stored(judged, "judged")

    def settle(batch: pa.RecordBatch) -> Iterator[dict]:
        v = matrix(batch.column(3), dims)
        was = batch.column(2).to_numpy()
        now, _ = nearest(v, file.candidates(unpacked(batch.column(1), dims), centroids), centroids)
        moved = now != was
        yield state_and_sums(batch.column(0), batch.column(1), now, sums_of(was[moved], v[moved], -1, k) + sums_of(now[moved], v[moved], 1, k))

    fetched = judged.where("fetch").drop("fetch").join(whole.select("row", "v"), "row").select("row", "cells", "cluster", "v")
    kept = judged.where("not fetch").select("row", "cells", "cluster", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<bigint>").alias("sums"))
    out = stored(kept.unionByName(map_rows(fetched, MOVED, settle)), "assigned")
    discard(judged)
    return out


def drop(bucket: DataFrame) -> None:
    """Delete a table made by :func:`bucketed`, files and catalog entry."""
    name = bucket._jdf.queryExecution().analyzed().collectLeaves().head().catalogTable().get().identifier().table()
    discard(bucket)
    bucket.sparkSession.sql(f"drop table if exists {name}")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def assigned_sql(source: str) -> str:
    """Nearest centroid of every vector."""
    distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"select row, arg_min(n, (d, n)) as n, min(d) as d from (select k.row, c.n, {distance} as d from k, {source} c) group by row"


def round_sql(i: int) -> str:
    """Assignment and centroids of one round."""
    return f"""
a{i} as materialized ({assigned_sql(f"c{i - 1}")}),
s{i} as (select n, list(m order by i) as v from (select a.n, x.i, sum(x.x) // count(*) - (case when sum(x.x) % count(*) < 0 then 1 else 0 end) as m from a{i} a join parts x on x.row = a.row group by a.n, x.i) group by n),
c{i} as materialized (select c.n, coalesce(s.v, c.v) as v from c{i - 1} c left join s{i} s on s.n = c.n)"""


SQL = f"""
with whole as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where len(embedding) = {DIMS}),
k as materialized (select row, vec_id, list_transform(e, lambda x: floor(x * {SCALE})::hugeint) as v from whole where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
parts as materialized (select row, unnest(v) as x, unnest(range({DIMS})) as i from k),
c0 as materialized (select row_number() over (order by h, v) - 1 as n, v from (select sha256('{SEED}:' || vec_id::varchar) as h, v from k where vec_id is not null order by h, v limit {K})),
{",".join(map(round_sql, range(1, ROUNDS + 1)))},
last as ({assigned_sql(f"c{ROUNDS}")})
select k.vec_id, l.n::int as cluster, l.d::bigint as distance, (sum(l.d) over (partition by l.n))::bigint as cluster_inertia, (sum(l.d) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from last l join k on k.row = l.row join c{ROUNDS} c on c.n = l.n
"""
