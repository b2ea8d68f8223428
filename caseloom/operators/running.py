"""Running sums and folds in which no key's history is one task's.

Rows are cut into slices of the range of (key, order), so a key with a third of
all rows lies in a third of the slices.  Each slice sums up what it does to
whatever comes in; those summaries, one for a slice and key, are put together
in order; and where every row has a result, slices run again from what comes
in to them.  A key that fits one slice costs one summary.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseloom.sources.scratch import stored

SLICE = "__slice"


def sliced(rows: DataFrame, keys: list[str], order: list[Column | str], slices: int | None = None) -> DataFrame:
    """``rows``, stored, with the number of the stretch of (keys, order) that each lies in; stretches have about equal rows."""
    n = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *keys, *order).withColumn(SLICE, F.spark_partition_id()), "slices")


def running_total(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, into: str, slices: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``cost`` over the rows of their keys up to and with each, in ascending ``order``.

    A slice hears what its keys summed up to before it as one more row, ahead of
    its own; so one window over (slice, keys) gives sums over all slices.
    """
    names, places = [f"__k{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(order))]
    named = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)] + [o.alias(p) for o, p in zip(order, places, strict=True)]
    flat = sliced(rows.select(F.struct("*").alias("__row"), *named, cost.alias("__cost")), names, places, slices)
    totals = flat.groupBy(SLICE, *names).agg(F.sum("__cost").alias("__sum"))
    before = F.sum("__sum").over(W.partitionBy(*names).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1))
    carried = totals.select(SLICE, *names, before.alias("__cost"), F.lit(False).alias("__own")).where("__cost is not null")
    every = flat.withColumn("__own", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    upto = W.partitionBy(SLICE, *names).orderBy("__own", *places).rowsBetween(W.unboundedPreceding, W.currentRow)
    return every.withColumn("__sum", F.sum("__cost").over(upto)).where("__own").select("__row.*", F.col("__sum").alias(into))


class Fold:
    """A state that follows from rows taken in order, and what a stretch of rows does to any state that comes in.

    States and summaries are plain JSON values.
    """

    def start(self) -> object:
        """The state before any row."""
        raise NotImplementedError

    def step(self, state: object, *values: object) -> tuple[object, tuple]:
        """The state after a row, and what is put out for it."""
        raise NotImplementedError

    def nothing(self) -> object:
        """What no rows do."""
        raise NotImplementedError

    def extend(self, held: object, *values: object) -> object:
        """What the rows so far and one more do."""
        raise NotImplementedError

    def summary(self, held: object) -> object:
        return held

    def apply(self, summary: object, state: object) -> object:
        """The state after a stretch that ``state`` came into."""
        raise NotImplementedError

    def last(self, state: object) -> tuple:
        """What is put out for a key with this state at its end."""
        raise NotImplementedError


def folded(rows: DataFrame, key: str, order: list[str], fold: Fold, schema: str, each: bool, slices: int | None = None) -> DataFrame:
    """Rows of each key run through ``fold`` in the order of the columns ``order``, which are also what it takes.

    Puts out the key and, of every row (``each``) or of the last, the tuple that
    the fold gives; ``schema`` has the key first.
    """
    types = dict(rows.dtypes)
    kind = f"`{key}` {types[key]}"
    dealt = sliced(rows.select(key, *order), [key], order, slices)
    cut = dealt.repartition(SLICE, key).sortWithinPartitions(SLICE, key, *order)

    def summed(groups: Iterator[tuple]) -> Iterator[tuple]:
        for (number, k), members in groups:
            held = fold.nothing()
            for values in members:
                held = fold.extend(held, *values)
            yield number, k, json.dumps(fold.summary(held))

    told = in_groups(cut.select(SLICE, key, *order), 2, summed, f"{SLICE} int, {kind}, told string")

    def composed(groups: Iterator[tuple]) -> Iterator[tuple]:
        for (k,), members in groups:
            state = fold.start()
            for number, summary in members:
                if each:
                    yield number, k, json.dumps(state)
                state = fold.apply(json.loads(summary), state)
            if not each:
                yield (k, *fold.last(state))

    stretches = told.select(key, SLICE, "told").repartition(key).sortWithinPartitions(key, SLICE)
    if not each:
        return in_groups(stretches, 1, composed, schema)
    states = in_groups(stretches, 1, composed, f"{SLICE} int, {kind}, __state string")
    both = dealt.withColumn("__own", F.lit(True)).unionByName(states.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    both = both.repartition(SLICE, key).sortWithinPartitions(SLICE, key, "__own", *order)

    def run(groups: Iterator[tuple]) -> Iterator[tuple]:
        for (_, k), members in groups:
            state = json.loads(next(members)[0])
            for _, *values in members:
                state, out = fold.step(state, *values)
                yield (k, *out)

    return in_groups(both.select(SLICE, key, "__state", *order), 2, run, schema)


def in_groups(rows: DataFrame, n: int, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` over sorted rows as (first ``n`` values, the rest of each row) by runs of equal first values, a row at a time."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = ((k, (r[n:] for r in members)) for k, members in groupby(flat(batches), key=lambda r: r[:n]))
        out = fn(groups)
        while rows_ := list(islice(out, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_, strict=True), kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, schema)
