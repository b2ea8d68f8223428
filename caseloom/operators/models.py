"""Calls of embedders and models over whole tables: what is sent, what comes back, and what happens when it doesn't.

The call itself is an argument: a function from a list of texts to a list of
vectors or answers.  It runs inside Arrow functions, in batches bounded by
bytes, and never on the driver.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseloom.functions import json_text
from caseloom.operators import rules
from caseloom.sources.scratch import brief_shuffles, exists, stored

Call = Callable[[list[str]], Sequence]
#: Bytes of text in one call.
CALL_BYTES = 1 << 18
#: What rows get that a breaker has held back.
HELD = "held back after a failure"


class RowError(ValueError):
    """A call failed for what one text is, not for the state of the service: other rows go on."""


class Breaker:
    """Lets calls through until one fails; then none until ``cooldown`` seconds have passed (None: none any more)."""

    def __init__(self, cooldown: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.cooldown, self.clock, self.until, self.reason = cooldown, clock, -math.inf, None

    def open(self) -> bool:
        return self.reason is not None and self.clock() < self.until

    def failed(self, reason: str) -> None:
        self.reason, self.until = reason, math.inf if self.cooldown is None else self.clock() + self.cooldown


def by_bytes(texts: Sequence[str], size: int) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive texts of about ``size`` bytes; a larger text is alone."""
    low, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t.encode())
        if i > low and total + n > size:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(texts):
        yield low, len(texts)


def called(fn: Call, texts: list[str], breaker: Breaker) -> list[tuple[object, str | None]]:
    """(result, why there is none) of every text.

    A text that the call refuses as such is told apart by halves, so its
    neighbours keep their results; any other failure opens the breaker, and
    what hasn't been answered is held back.
    """
    if breaker.open():
        return [(None, f"{HELD}: {breaker.reason}")] * len(texts)
    try:
        got = list(fn(texts))
        if len(got) != len(texts):
            raise ValueError(f"{len(texts)} texts gave {len(got)} results")
        return [(x, None) for x in got]
    except RowError as e:
        if len(texts) == 1:
            return [(None, str(e))]
        half = len(texts) // 2
        return called(fn, texts[:half], breaker) + called(fn, texts[half:], breaker)
    except Exception as e:  # noqa: BLE001  whatever a service raises
        breaker.failed(f"{type(e).__name__}: {e}"[:500])
        return [(None, f"{HELD}: {breaker.reason}")] * len(texts)


def in_calls(fn: Call, texts: list[str], breaker: Breaker, call_bytes: int) -> list[tuple[object, str | None]]:
    """Results of a batch: blank texts need no call, equal texts share one."""
    distinct = list(dict.fromkeys(t for t in texts if t.strip()))
    found: dict[str, tuple] = {}
    for low, high in by_bytes(distinct, call_bytes):
        found.update(zip(distinct[low:high], called(fn, distinct[low:high], breaker), strict=True))
    return [found.get(t, (None, None)) for t in texts]


def fault(vector: object, dimension: int) -> str | None:
    """Why a vector can't be stored, or None."""
    if vector is None:
        return "no vector was returned"
    if len(vector) != dimension:
        return f"dimension {len(vector)} instead of {dimension}"
    if not all(x is not None and math.isfinite(x) for x in vector):
        return "not all components are finite"
    return None if any(vector) else "all components are zero"


def with_columns_from(rows: DataFrame, text: str, added: T.StructType, fn: Callable[[], Callable[[list[str]], list[tuple]]]) -> DataFrame:
    """``rows`` with ``added`` computed from batches of texts; ``fn()`` makes one function for each task, which may hold state."""
    clash = set(added.names) & set(rows.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    names, kinds = [*rows.columns, *added.names], [f.type for f in to_arrow_schema(added)]
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = fn()
        for batch in batches:
            out = one([t or "" for t in batch.column(at).to_pylist()])
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def embed(rows: DataFrame, text: str, fn: Call, dimension: int, into: str = "embedding", warning: str = "embedding_warning", unit: bool = True, call_bytes: int = CALL_BYTES, cooldown: float | None = None) -> DataFrame:
    """``rows`` with a vector of ``dimension`` components and a warning where there is none.

    A row never fails for its vector.  A vector of the wrong length, with a
    component that isn't finite, or of zeros is left out with the reason, for
    its row alone, as is a text that ``fn`` refuses by :class:`RowError`.  Any
    other failure holds back the rest of the task's rows (or those of the next
    ``cooldown`` seconds) with a warning that names it.  Blank texts have
    neither vector nor warning.  Every column stays; nothing is shuffled.
    """

    def task() -> Callable[[list[str]], list[tuple]]:
        breaker = Breaker(cooldown)

        def one(texts: list[str]) -> list[tuple]:
            out = []
            for t, (v, why) in zip(texts, in_calls(fn, texts, breaker, call_bytes), strict=True):
                why = why or (fault(v, dimension) if t.strip() else None)
                if why or v is None:
                    out.append((None, why))
                    continue
                v = [float(x) for x in v]
                size = math.sqrt(math.fsum(x * x for x in v)) if unit else 1.0
                out.append(([x / size for x in v], None))
            return out

        return one

    return with_columns_from(rows, text, T.StructType([T.StructField(into, T.ArrayType(T.DoubleType())), T.StructField(warning, T.StringType())]), task)


def apply_model(rows: DataFrame, content: str, wanted: Column, fn: Call, store: str, slices: int = 8, call_bytes: int = CALL_BYTES, cooldown: float | None = None) -> DataFrame:
    """``rows`` with ``answer`` and ``outcome``: 'skipped' where the gate doesn't want a call, 'ok', or 'failed' with no answer.

    Calls are keyed by the SHA-256 of their content: one call for equal
    contents, and none for those that ``store`` (a folder, shared by restarts
    and later jobs) holds an answer to.  Contents are called in ``slices`` of
    the key, each committed by itself, so what a job that died had committed is
    not called again; failures are kept out of the store and tried anew by the
    next run.  Blank contents are never sent.
    """
    spark = rows.sparkSession
    gate = F.coalesce(wanted, F.lit(False)) & (F.length(F.trim(F.coalesce(F.col(content), F.lit("")))) > 0)
    keyed = stored(rows.withColumn("__key", F.when(gate, F.sha2(F.col(content), 256))), "keyed")
    asked = keyed.where("__key is not null").groupBy("__key").agg(F.first(content).alias("__content"))
    asked = asked.withColumn("__slice", F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") % slices)
    schema = "__key string, answer string, why string"

    def known() -> DataFrame:
        if not exists(spark, store):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(store).groupBy("__key").agg(F.first("answer").alias("answer"))

    open_ = stored(asked.join(known(), "__key", "left_anti"), "asked")
    failed = None
    for part in sorted(r[0] for r in open_.select("__slice").distinct().collect()):  # at most ``slices`` numbers
        some = open_.where(F.col("__slice") == part).select("__key", "__content")
        answers = stored(with_columns_from(some, "__content", T.StructType([T.StructField("answer", T.StringType()), T.StructField("why", T.StringType())]), lambda: answering(fn, cooldown, call_bytes)).drop("__content"), "answers")
        with brief_shuffles(spark):
            answers.where("why is null and answer is not null").write.mode("append").parquet(store)
        lost = answers.where("why is not null or answer is null").select("__key", F.coalesce("why", F.lit("no answer")).alias("why"))
        failed = lost if failed is None else failed.unionByName(lost)
    # rows without a call stay out of the join: their keys are all null
    called_ = keyed.where("__key is not null").join(known(), "__key", "left")
    called_ = called_.join(failed, "__key", "left") if failed is not None else called_.withColumn("why", F.lit(None).cast("string"))
    called_ = called_.withColumn("outcome", F.when(F.col("answer").isNull(), "failed").otherwise("ok")).select(*rows.columns, "answer", "outcome", "why")
    none = F.lit(None).cast("string")
    return called_.unionByName(keyed.where("__key is null").select(*rows.columns, none.alias("answer"), F.lit("skipped").alias("outcome"), none.alias("why")))


def answering(fn: Call, cooldown: float | None, call_bytes: int) -> Callable[[list[str]], list[tuple]]:
    breaker = Breaker(cooldown)
    return lambda texts: in_calls(fn, texts, breaker, call_bytes)


def decided(rule: Column, answer: Column, outcome: Column, categories: Sequence[str]) -> Column:
    """A struct of category, summary, urgency and evidence: the answer's values where it is valid, else the rule's.

    ``evidence`` is 'model', 'rule', 'rule after failure' or 'rule after an invalid answer'.
    """
    checked = rules.validated(json_text.object_in(answer), categories, rule["category"])
    used = (outcome == "ok") & checked["by_model"]
    evidence = F.when(used, "model").when(outcome == "failed", "rule after failure").when(outcome == "ok", "rule after an invalid answer").otherwise("rule")
    return F.struct(
        F.when(used, checked["category"]).otherwise(rule["category"]).alias("category"), F.when(used, checked["summary"]).alias("summary"),
        F.when(used, checked["urgency"]).otherwise("medium").alias("urgency"), evidence.alias("evidence"),
    )
