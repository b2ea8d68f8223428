"""Repeated passages through a log-structured index of window fingerprints.

A window is ``width`` consecutive words.  Its fingerprint is the least hash of
the shorter word runs inside it, so equal windows have equal fingerprints and
neighbouring windows mostly share one: the index holds about a seventh as many
entries as there are windows, and loses none.

Each batch becomes an immutable run: fingerprints with their documents,
bucketed and sorted by fingerprint.  The run is merge-joined with the runs of
earlier batches without moving those; windows whose fingerprint occurs
elsewhere are read from their texts and verified by a further digest of all
their words.  When more than ``fan_out`` runs have gathered, they are merged into one.

A document's words are removed if a window over them starts earlier in the
index's order (smaller doc_id, or the same document further up).  Batches come
in ascending order of doc_id, and one that doesn't is refused.

Defined cases.  A null or empty text has no words.  Texts shorter than a window
are kept whole, very long ones are handled whole.  Equal windows of one document
go by their place.  Columns beside doc_id and text are not read.  Rows that repeat a doc_id are one document.  Documents with a
null doc_id are kept whole and witness nothing.  An empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import brief_shuffles, discard, folder, map_rows, small_batches, stored, table

WIDTH, INNER = 20, 8
#: Two runs of a level become one of the next.
FAN_OUT = 1
BATCHES = 2
#: A fingerprint of more documents than this is dealt to so many parts.
HOT, SPREAD = 5000, 64


MANIFEST = "version bigint, place int, kind string, path string, level int, buckets int, width int, last bigint"
ENTRIES, TEXTS = "h bigint, doc_id bigint, n int", "doc_id bigint, text string"
STARTS = "array<struct<low:int,high:int>>"


def split_batch(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of each text, and where each text's words start when all are in one row."""
    words = [(t or b"").split() for t in texts]
    return words, np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


def word_hashes(words: list[list[bytes]]) -> np.ndarray:
    flat = np.empty(sum(map(len, words)), object)
    flat[:] = [w for x in words for w in x]
    codes, distinct = pd.factorize(flat)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes] if len(flat) else np.zeros(0, np.uint64)


def run_hashes(h: np.ndarray, inner: int = INNER) -> np.ndarray:
    """A mixed hash of the ``inner`` words from each word on."""
    n = max(0, len(h) - inner + 1)
    g = np.zeros(n, np.uint64)
    for j in range(inner):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    return g


def least(g: np.ndarray, span: int) -> np.ndarray:
    """The least of ``span`` neighbours from each place on."""
    have, low = 1, g
    while 2 * have <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    rest = span - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def window_fingerprints(words: list[list[bytes]], starts: np.ndarray, width: int = WIDTH, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run hashes, and the start and fingerprint of every window that lies within one text."""
    g = run_hashes(word_hashes(words), inner)
    span = width - inner + 1
    if len(g) < span:
        return g, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = least(g, span)
    ends = np.repeat(starts[1:], np.diff(starts))[: len(low)]
    at = np.flatnonzero(np.arange(len(low)) + width <= ends)
    return g, at, low[at]


def entries(docs: DataFrame, width: int = WIDTH, inner: int = INNER) -> DataFrame:
    """``h, doc_id, n``: the fingerprints of each document and how many places in it have them."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        words, starts = split_batch(batch.column(1).to_pylist())
        g, at, low = window_fingerprints(words, starts, width, inner)
        mark = np.zeros(len(g), bool)
        for o in range(width - inner + 1):
            mark[at[low == g[at + o]] + o] = True
        place = np.flatnonzero(mark)
        doc = np.searchsorted(starts, place, "right") - 1
        order = np.lexsort((g[place], doc))
        doc, h = doc[order], g[place][order]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        yield {"h": h[first].view(np.int64), "doc_id": batch.column(0).to_numpy()[doc[first]] if len(first) else [], "n": np.diff(np.append(first, len(doc)))}

    return map_rows(docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("t")), ENTRIES, run)


def windows(docs: DataFrame, width: int = WIDTH, inner: int = INNER) -> DataFrame:
    """Stretches of windows that share a fingerprint among the row's ``hs``: ``h, part, doc_id, start, digests, is_new``.

    ``digests`` packs eight bytes per window; with the fingerprint, which is of
    other words, equal windows are told apart by 128 bits.  Stretches of a
    fingerprint among ``hot`` are cut into single windows dealt to ``SPREAD`` parts.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        words, starts = split_batch(batch.column(1).to_pylist())
        _, at, low = window_fingerprints(words, starts, width, inner)
        take = np.isin(low, batch.column(2).flatten().to_numpy().view(np.uint64))
        at, low = at[take], low[take]
        often = set(batch.column(3).flatten().to_numpy().view(np.uint64).tolist())
        doc = np.searchsorted(starts, at, "right") - 1
        ids, new = batch.column(0).to_pylist(), batch.column(4).to_pylist()
        first = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))) if len(at) else np.zeros(0, bool)
        cuts = np.append(np.flatnonzero(first), len(at)).tolist()
        out: dict[str, list] = {k: [] for k in ("h", "part", "doc_id", "start", "digests", "is_new")}
        local, hashes, signed = (at - starts[doc]).tolist(), low.tolist(), low.view(np.int64).tolist()
        held, text, edge = -1, b"", [0]
        for a, b in zip(cuts, cuts[1:]):
            d = int(doc[a])
            if d != held:
                held, text = d, b" ".join(words[d])
                edge = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words[d]]))).tolist()
            packed = [xxhash.xxh3_64_digest(text[edge[s] : edge[s + width] - 1]) for s in local[a:b]]
            hot = hashes[a] in often
            for part, start, digests in [(1 + x[0] % SPREAD, local[a + k], x) for k, x in enumerate(packed)] if hot else [(0, local[a], b"".join(packed))]:
                for k, v in zip(out, (signed[a], part, ids[d], start, digests, new[d])):
                    out[k].append(v)
        yield out

    return map_rows(docs, "h bigint, part int, doc_id bigint, start int, digests binary, is_new boolean", run)


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, low, high``: stretches of new windows that were seen at an earlier place; rows come sorted by ``h, part, doc_id, start``."""
    now, seen = None, {}
    for batch in batches:
        found = []
        for h, part, doc, start, digests, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (h, part):
                now, seen = (h, part), {}
            low = high = -1
            for k in range(len(digests) // 8):
                first = seen.setdefault(digests[8 * k : 8 * k + 8], (doc, start + k))
                if new and first < (doc, start + k):
                    if start + k != high:
                        if high > low:
                            found.append((doc, low, high))
                        low = start + k
                    high = start + k + 1
            if high > low:
                found.append((doc, low, high))
        cols = zip(*found) if found else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "low", "high"])


class SubstringIndex:
    """Runs of fingerprints and the texts they came from, in one folder.

    Every change appends a version of the manifest, a row for each table in use;
    a table that no version after the last names is never read.  One job at a time may add.
    """

    def __init__(self, spark: SparkSession, place: str | None = None, buckets: int | None = None, width: int = WIDTH, fan_out: int = FAN_OUT):
        self.spark, self.width, self.fan_out = spark, width, fan_out
        self.place = place or folder(spark, "substrings")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = 0
        #: Paths of the runs with their levels, and of the texts.
        self.runs: list[tuple[str, int]] = []
        self.texts: list[str] = []
        self.names: dict[str, str] = {}
        #: The greatest id so far.
        self.last: int | None = None

    @classmethod
    def open(cls, spark: SparkSession, place: str, fan_out: int = FAN_OUT) -> "SubstringIndex":
        """The index that an earlier job left in ``place``."""
        every = spark.read.schema(MANIFEST).json(f"{place}/manifest")
        rows = every.join(every.agg(F.max("version").alias("version")), "version").orderBy("place").collect()
        if not rows:
            raise ValueError(f"no index in {place}")
        index = cls(spark, place, rows[0].buckets, rows[0].width, fan_out)
        index.version, index.last = rows[0].version, rows[0].last
        index.runs = [(r.path, r.level) for r in rows if r.kind == "run"]
        index.texts = [r.path for r in rows if r.kind == "text"]
        return index

    def commit(self) -> None:
        """Append a version of the manifest."""
        self.version += 1
        rows = [("run", p, level) for p, level in self.runs] + [("text", p, 0) for p in self.texts]
        self.spark.createDataFrame([(self.version, i, *r, self.buckets, self.width, self.last) for i, r in enumerate(rows)], MANIFEST).coalesce(1).write.mode("append").json(f"{self.place}/manifest")

    def save(self, rows: DataFrame, key: str, dealt: bool = False) -> str:
        """An immutable table, bucketed and sorted by ``key``; ``dealt``: its buckets are the partitions of ``rows`` already."""
        name = f"t_{uuid.uuid4().hex}"
        path = f"{self.place}/{name}"
        with brief_shuffles(self.spark):
            (rows if dealt else rows.repartition(self.buckets, key)).write.bucketBy(self.buckets, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(name)
        self.names[path] = name
        return path

    def table(self, path: str, key: str, columns: str) -> DataFrame:
        """A table of the index; those of earlier jobs are made known to this session's catalog."""
        if path not in self.names:
            self.names[path] = f"t_{uuid.uuid4().hex}"
            quoted = path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"create table {self.names[path]} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{quoted}'")
        return self.spark.table(self.names[path])

    def run(self, path: str) -> DataFrame:
        return self.table(path, "h", ENTRIES)

    def compact(self) -> None:
        """Merge the runs of each level that has too many; buckets meet where they lie."""
        level = 0
        while level <= max((at for _, at in self.runs), default=-1):
            old = [p for p, at in self.runs if at == level]
            if len(old) > self.fan_out:
                both = reduce(DataFrame.unionByName, map(self.run, old)).groupBy("h", "doc_id").agg(F.sum("n").cast("int").alias("n"))
                self.runs = [(p, at) for p, at in self.runs if at != level] + [(self.save(both, "h", dealt=True), level + 1)]
                self.commit()
                for path in old:
                    discard(self.run(path))
                    self.spark.sql(f"drop table {self.names.pop(path)}")
            level += 1

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Index ``doc_id, text`` of ids above all earlier ones; a batch with a lower id is refused.

        Returns the stored texts, and ``doc_id, starts``: stretches of window starts of the batch that are earlier in the index.
        """
        text = self.save(docs, "doc_id")
        own_texts = self.table(text, "doc_id", TEXTS)
        least, greatest = own_texts.agg(F.min("doc_id"), F.max("doc_id")).first()
        if None not in (least, self.last) and least <= self.last:
            discard(own_texts)
            self.spark.sql(f"drop table {self.names.pop(text)}")
            raise ValueError(f"the index has documents up to {self.last}: a batch with document {least} cannot follow")
        self.last = self.last if greatest is None else greatest
        path = self.save(entries(own_texts, self.width), "h")
        new, runs = self.run(path), [self.run(p) for p, _ in self.runs]
        own = new.groupBy("h").agg(F.sum("n").alias("n"))
        past = [r.join(own.select("h"), "h", "left_semi").select("h", "doc_id", F.lit(False).alias("is_new")) for r in runs]
        again = own.where("n > 1").select("h")
        for r in runs:
            again = again.unionByName(own.select("h").join(r.select("h"), "h", "left_semi"))
        held = stored(reduce(DataFrame.unionByName, [new.join(again.distinct(), "h", "left_semi").select("h", "doc_id", F.lit(True).alias("is_new")), *past]), "held")
        self.runs.append((path, 0))
        self.texts.append(text)
        self.commit()
        self.compact()
        often = held.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("often"))
        marked = held.join(often, "h", "left")
        wanted = marked.groupBy("doc_id").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("often"), F.col("h"))).alias("hot"), F.bool_or("is_new").alias("is_new"))
        texts = reduce(DataFrame.unionByName, [self.table(p, "doc_id", TEXTS) for p in self.texts])
        found = windows(texts.join(wanted, "doc_id").select("doc_id", F.col("text").cast("binary").alias("t"), "hs", "hot", "is_new"), self.width)
        order = ["h", "part", "doc_id", "start"]
        repeated = found.repartition("h", "part").sortWithinPartitions(*order).select(*order, "digests", "is_new").mapInArrow(later, "doc_id bigint, low int, high int")
        starts = stored(repeated.groupBy("doc_id").agg(F.collect_set(F.struct("low", "high")).alias("starts")), "starts")
        discard(held)
        return own_texts, starts


def kept(docs: DataFrame, starts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        n_words, n_removed, texts = [], [], []
        for t, s in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = (t or b"").split()
            if s.is_valid and len(s):
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, s.values.field("low").to_numpy(), 1)
                np.add.at(step, s.values.field("high").to_numpy() + width - 1, -1)
                stay = np.cumsum(step)[:-1] == 0
                left = [w for w, k in zip(words, stay.tolist(), strict=True) if k]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            texts.append(b" ".join(left))
        yield {"doc_id": batch.column(0), "n_words": n_words, "n_removed": n_removed, "kept_text": texts}

    joined = docs.select("doc_id", F.col("text").cast("binary").alias("t")).join(starts, "doc_id", "left")
    return map_rows(joined, "doc_id bigint, n_words bigint, n_removed bigint, kept_text binary", run)


def deduplicated(docs: DataFrame, batches: int = BATCHES, width: int = WIDTH, fan_out: int = FAN_OUT, index: SubstringIndex | None = None) -> DataFrame:
    """All of ``docs`` (doc_id, text) through ``index``, or a fresh one, a batch of ascending ids at a time."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    index = index or SubstringIndex(docs.sparkSession, width=width, fan_out=fan_out)
    whole = docs.where("doc_id is null")
    done = [kept(whole, docs.sparkSession.createDataFrame([], f"doc_id bigint, starts {STARTS}"), index.width)]
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = docs.where("doc_id is not null") if low is None else docs.where(F.col("doc_id") > low)
        part = part if high is None else part.where(F.col("doc_id") <= high)
        done.append(kept(*index.add(part), index.width))
    return reduce(DataFrame.unionByName, done)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
