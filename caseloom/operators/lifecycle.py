"""State that follows from events: folds, guards, retention and resumption."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.operators.running import Fold, folded

# Moves between states that are allowed.
MOVES = {"received": ["in progress", "cancelled"], "in progress": ["done", "cancelled", "received"], "done": [], "cancelled": []}


class Status(Fold):
    """State and number of rejected moves over (order, wanted); a stretch is known by what it does to each state."""

    def __init__(self, first: str, moves: dict[str, list[str]]):
        self.first, self.moves = first, moves
        self.states = sorted({first, *moves, *(x for to in moves.values() for x in to)})

    def moved(self, state: list, to: str | None) -> list:
        now, rejected = state
        return [to, rejected] if to in self.moves.get(now, ()) else [now, rejected + 1]

    def start(self) -> list:
        return [self.first, 0]

    def step(self, state: list, at: object, to: str | None) -> tuple[list, tuple]:
        state = self.moved(state, to)
        return state, tuple(state)

    def nothing(self) -> dict:
        return {s: [s, 0] for s in self.states}

    def extend(self, held: dict, at: object, to: str | None) -> dict:
        return {s: self.moved(x, to) for s, x in held.items()}

    def apply(self, summary: dict, state: list) -> list:
        now, rejected = summary[state[0]]
        return [now, rejected + state[1]]

    def last(self, state: list) -> tuple:
        return tuple(state)


class Breaker(Fold):
    """Outcome of each call over (at, call, bad); state is the moment until which calls are skipped.

    A stretch is known by its failures: each with the moment that the last one
    leaves behind, if it is the first that isn't skipped.  A call without a
    moment is never skipped, and one without a verdict is 'ok'.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def start(self) -> int | None:
        return None

    def step(self, until: int | None, now: int | None, call: object, bad: bool | None) -> tuple[int | None, tuple]:
        if now is not None and until is not None and now < until:
            return until, (call, "skipped")
        if bad:
            return until if now is None else now + self.seconds, (call, "failed")
        return until, (call, "ok")

    def nothing(self) -> list:
        return []

    def extend(self, held: list, now: int | None, call: object, bad: bool | None) -> list:
        if bad and now is not None:
            held.append(now)
        return held

    def summary(self, held: list) -> list:
        ends = [0] * len(held)
        for i in range(len(held) - 1, -1, -1):
            after = bisect_left(held, held[i] + self.seconds, lo=i + 1)
            ends[i] = ends[after] if after < len(held) else held[i] + self.seconds
        # of failures in a row that end alike, the last says it all
        return [[a, e] for i, (a, e) in enumerate(zip(held, ends, strict=True)) if i + 1 == len(ends) or ends[i + 1] != e]

    def apply(self, summary: list, until: int | None) -> int | None:
        at = 0 if until is None else bisect_left(summary, until, key=lambda x: x[0])
        return summary[at][1] if at < len(summary) else until


def fold(events: DataFrame, key: str, order: str, wanted: str, first: str = "received", moves: dict[str, list[str]] = MOVES, slices: int | None = None) -> DataFrame:
    """State and number of rejected moves of each key, its events applied in order; no key's events are one task's."""
    return folded(events, key, [order, wanted], Status(first, moves), f"`{key}` {dict(events.dtypes)[key]}, state string, rejected bigint", each=False, slices=slices)


def current_results(results: DataFrame, rows: DataFrame, key: str, revision: str) -> tuple[DataFrame, DataFrame]:
    """Results that fit the present revision of their row, and those that came late."""
    fits = results.join(rows.select(key, revision), [key, revision], "left_semi")
    return fits, results.join(rows.select(key, revision), [key, revision], "left_anti")


def stale(jobs: DataFrame, beat: str, now: Column, seconds: int = 300) -> DataFrame:
    return jobs.where(F.unix_timestamp(now) - F.unix_timestamp(beat) > seconds)


def drafts_left(events: DataFrame, key: str, author: str, order: str, kind: str) -> DataFrame:
    """The last draft of each author, unless a reply was sent after it."""
    last = events.groupBy(key, author).agg(F.max_by(kind, order).alias("last"), F.max(order).alias(order))
    return last.where("last = 'draft'").select(key, author, order)


def archived(rows: DataFrame, when: Column, status: str, owner: str) -> DataFrame:
    """Rows put away: status kept aside, owner detached."""
    return rows.withColumn("saved_status", F.when(when, F.col(status))).withColumn(owner, F.when(~when, F.col(owner)))


def restored(rows: DataFrame, status: str, replied: Column) -> DataFrame:
    """Rows brought back: the saved status, or the one that follows from replies."""
    return rows.withColumn(status, F.coalesce("saved_status", F.when(replied, "done").otherwise("received"))).drop("saved_status")


def bounded(rows: DataFrame, group: str, order: list[Column], capacity: int) -> DataFrame:
    """At most ``capacity`` rows of each group, the newest purged first once it is over."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= capacity).drop("place")


def pending_chunks(chunks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Second phase: chunks without a result for the same content."""
    return chunks.join(done.select(*keys), keys, "left_anti")


def deleted(rows: DataFrame, key: str, ids: DataFrame, in_scope: Column) -> DataFrame:
    """All of the ids or none: rows stay as they are if any id is missing or out of scope."""
    wanted = ids.select(key).distinct()
    found = rows.where(in_scope).join(wanted, key, "left_semi").select(key).distinct()
    refused = wanted.join(found, key, "left_anti").limit(1).select(F.lit(True).alias("__refused"))
    gone = wanted.withColumn("__k", F.lit(1)).join(refused.withColumn("__k", F.lit(1)), "__k", "left_anti").select(key)
    return rows.join(gone, key, "left_anti")


def compacted(turns: DataFrame, conversation: str, order: str, role: str, text: str, stub: str = "(earlier result)") -> DataFrame:
    """Tool results before the latest one of a conversation become a stub."""
    latest = F.max(F.when(F.col(role) == "tool", F.col(order))).over(W.partitionBy(conversation))
    return turns.withColumn(text, F.when((F.col(role) == "tool") & (F.col(order) < latest), stub).otherwise(F.col(text)))


def with_breaker(rows: DataFrame, order: str, failed: Column, group: str, at: str, seconds: int, slices: int | None = None) -> DataFrame:
    """Outcome of each call: skipped while less than ``seconds`` have passed since the last real failure."""
    types = dict(rows.dtypes)
    flat = rows.select(F.col(group), F.col(at).alias("__at"), F.col(order).alias("__call"), failed.alias("__bad"))
    return folded(flat, group, ["__at", "__call", "__bad"], Breaker(seconds), f"`{group}` {types[group]}, `{order}` {types[order]}, outcome string", each=True, slices=slices)
