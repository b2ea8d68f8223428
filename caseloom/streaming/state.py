"""State by key in streams: value state, event-time timers and expiry.

Processors for ``transformWithState``.  Each keeps one small value a key,
whatever the length of its history; the values lie in the state store of the
query's checkpoint, so a restart goes on where the last batch ended.  Rows of
a batch are taken in the order of their time and number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caseloom.operators.lifecycle import MOVES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Inside, queries start with the state store that keyed processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Heartbeats(StatefulProcessor):
    """Tells when a key has been silent for more than ``seconds``, and when it comes back.

    Puts out ('stale', last beat, null) once time has passed the last beat by
    so much, and ('back', last beat before, beat) at the next one.  A silence
    that lies inside one batch is told as well.  Beats older than the last one
    change nothing.
    """

    def __init__(self, key: str, seconds: int):
        self.key, self.seconds = key, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "beat bigint, told boolean")

    def row(self, key: tuple, kind: str, beat: int, back: int | None) -> Row:
        return Row(**{self.key: key[0], "kind": kind, "beat": beat, "back": back})

    def due(self, beat: int) -> int:
        """The moment, in milliseconds, at which a key whose last beat was in second ``beat`` is stale."""
        return (beat + self.seconds) * 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        beats = sorted(r.beat for r in rows if r.beat is not None)
        held = self.last.get() if self.last.exists() else None
        before, told = (held[0], held[1]) if held else (None, False)
        was = before
        for b in beats:
            if before is not None and b > before + self.seconds:
                if not told:
                    yield self.row(key, "stale", before, None)
                yield self.row(key, "back", before, b)
            if before is None or b > before:
                before, told = b, False
        if before != was:
            if was is not None and not held[1]:
                self.handle.deleteTimer(self.due(was))
            self.last.update((before, False))
            self.handle.registerTimer(self.due(before))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        beat, _ = self.last.get()
        self.last.update((beat, True))
        yield self.row(key, "stale", beat, None)

    def close(self) -> None:
        pass


class Breakers(StatefulProcessor):
    """Outcome of each call of a key: skipped for ``seconds`` after one that failed.  A timer forgets the key when they are over."""

    def __init__(self, key: str, order: str, seconds: int):
        self.key, self.order, self.seconds = key, order, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        until = self.until.get()[0] if self.until.exists() else None
        was = until
        for r in sorted(rows, key=lambda r: (r.at, r[self.order])):
            if until is not None and r.at < until:
                outcome = "skipped"
            elif r.bad:
                until, outcome = r.at + self.seconds, "failed"
            else:
                outcome = "ok"
            yield Row(**{self.key: key[0], self.order: r[self.order], "outcome": outcome})
        if until != was:
            if was is not None:
                self.handle.deleteTimer(was * 1000)
            self.until.update((until,))
            self.handle.registerTimer(until * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


class Statuses(StatefulProcessor):
    """State of each key and number of its rejected moves, put out after every batch that has events of it."""

    def __init__(self, key: str, order: str, first: str = "received", moves: dict[str, list[str]] = MOVES):
        self.key, self.order, self.first, self.moves = key, order, first, moves

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "state string, rejected bigint, last bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        state, rejected, last = self.status.get() if self.status.exists() else (self.first, 0, None)
        for r in sorted(rows, key=lambda r: r[self.order]):
            state, rejected = (r.wanted, rejected) if r.wanted in self.moves.get(state, ()) else (state, rejected + 1)
            last = r[self.order]
        self.status.update((state, rejected, last))
        yield Row(**{self.key: key[0], "state": state, "rejected": rejected, "last": last})

    def close(self) -> None:
        pass


def by_key(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, timed: bool = True) -> DataFrame:
    return stream.groupBy(key).transformWithState(processor, schema, "Update", "EventTime" if timed else "None")


def run_keyed(out: DataFrame, checkpoint: str, commit: Callable[[DataFrame, int], None]) -> None:
    """Run to the end of what is there; output rows are those of the batches."""
    with keyed_state(out.sparkSession):
        out.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()


def stale_stream(stream: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Silences of keys from a stream of beats; rows without a key only tell the time."""
    told = stream.withWatermark(at, "0 seconds")
    beats = told.selectExpr(f"`{key}`", f"`{at}`", f"case when `{key}` is not null then unix_timestamp(`{at}`) end as beat")
    return by_key(beats, key, Heartbeats(key, seconds), f"`{key}` {dict(stream.dtypes)[key]}, kind string, beat bigint, back bigint")


def breaker_stream(stream: DataFrame, key: str, order: str, at: str, bad: str, seconds: int) -> DataFrame:
    types = dict(stream.dtypes)
    calls = stream.withWatermark(at, "0 seconds").selectExpr(f"`{key}`", f"`{order}`", f"`{at}` as __t", f"unix_timestamp(`{at}`) as at", f"{bad} as bad")
    return by_key(calls, key, Breakers(key, order, seconds), f"`{key}` {types[key]}, `{order}` {types[order]}, outcome string")


def status_stream(stream: DataFrame, key: str, order: str, wanted: str) -> DataFrame:
    types = dict(stream.dtypes)
    return by_key(stream.selectExpr(f"`{key}`", f"`{order}`", f"`{wanted}` as wanted"), key, Statuses(key, order), f"`{key}` {types[key]}, state string, rejected bigint, last bigint", timed=False)
