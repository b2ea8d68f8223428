"""Benchmark decontamination with an Aho-Corasick automaton.

The windows of the benchmark items are the patterns.  A document is normalised
once, scanned once, and hits are mapped back to its words and to offsets in
its own text.

The automaton's letters are word numbers.  A window of 13 words holds one whole
stretch of seven that starts at a multiple of seven in its item, so an item gives
these stretches as patterns, each with the six words before and after it in the
item: where a stretch is found, the words beside it tell which windows occur.
That takes a node for each word of the benchmark instead of some eighty.  A
stretch that has many surroundings (a phrase that many questions share) gives its
windows as patterns instead, so that no place of a text is held against a long list.

One automaton holds ``max_words`` words.  A larger benchmark has several, and a
task runs them in turn over a group of its documents, so that the documents are
still read once and one automaton is in memory at a time.  ``pass_bytes`` of
benchmark text are sent to a worker at once; only beyond that do further passes
follow, whose hits are stored beside the texts.  Nothing is left out at any size.

Defined cases.  A null or empty text has no words and no hits.  A table without
documents gives no rows.  Items without
words match nothing.  Rows that repeat an item_id are one item with the windows
of all of them; items without an id are one item with an empty one.  Repeated
documents are each judged.  An empty benchmark leaves every document clean.
Overlapping occurrences all count.  A text is scanned as a whole.  ``__hit`` may
not be a column of the documents, and ends the job with a clear error; all other
names may.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count, islice, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caseloom.llm.common import small_batches, stored, table

WIDTH = 13
#: Words of the benchmark in one automaton: some 50 MB in each worker, 300 MB where every stretch has many surroundings.
MAX_WORDS = 1 << 19
#: Text of the benchmark that is sent to a worker at once.
PASS_BYTES = 64 << 20
#: Bytes of documents that wait in a task while several automata run over them in turn.
GROUP_BYTES = 64 << 20
#: Surroundings that one place of a text is held against.
SURROUNDINGS = 8
#: Letters to lower case; everything ASCII that is neither letter nor digit to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def blocks(items: DataFrame, item_id: str, text: str, width: int, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items as normalised texts, at most ``most`` words at a time; a longer item comes in parts that share ``width - 1`` words."""
    most = max(most, 2 * width)
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).toLocalIterator():
        words = words_of(bytes(row.t or b""))
        for at in range(0, max(len(words) - width + 1, 1), most - width + 1):
            part = words[at : at + most]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            if part:
                block.append((row.i or "", b" ".join(part)))
                size += len(part)
    if block:
        yield block


def passes(every: Iterator[list[tuple[str, bytes]]], most: int) -> Iterator[list[list[tuple[str, bytes]]]]:
    """Blocks of at most ``most`` bytes together, or one."""
    now, size = [], 0
    for block in every:
        own = sum(len(t) for _, t in block)
        if now and size + own > most:
            yield now
            now, size = [], 0
        now.append(block)
        size += own
    if now:
        yield now


def same(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """How many words two sequences begin with alike."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


class Automaton:
    """Aho-Corasick over the word numbers of one block of items."""

    def __init__(self, block: list[tuple[str, bytes]], width: int = WIDTH):
        self.width, self.size = width, (width + 1) // 2
        self.beside = width - self.size
        self.numbers: dict[bytes, int] = {}
        whole: dict[tuple[int, ...], set[str]] = {}
        parts: dict[tuple[int, ...], dict[tuple, set[str]]] = {}
        for item, text in block:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split())
            if len(words) <= width:
                whole.setdefault(words, set()).add(item)
                continue
            for at in range(0, len(words) - self.size + 1, self.size):
                end = at + self.size
                sides = words[max(0, at - self.beside) : at][::-1], words[end : end + self.beside]
                parts.setdefault(words[at:end], {}).setdefault(sides, set()).add(item)
        for part in [p for p, sides in parts.items() if len(sides) > SURROUNDINGS]:
            for (left, right), owners in parts.pop(part).items():
                around = left[::-1] + part + right
                for at in range(len(around) - width + 1):
                    whole.setdefault(around[at : at + width], set()).update(owners)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words in whole.keys() | parts.keys():
            sides = tuple((left, right, tuple(owners)) for (left, right), owners in parts.get(words, {}).items())
            self.found.add_word(words, (len(words), tuple(whole.get(words, ())), sides))
        self.found.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, number of words, items) of stretches that the occurrences of windows make up."""
        if not words or not self.numbers:
            return []
        text, out = tuple(map(self.numbers.get, words, repeat(0))), []
        for last, (n, owners, sides) in self.found.iter(text):
            first, end = last - n + 1, last + 1
            if owners:
                out.append((first, n, owners))
            if sides:
                before, after = text[max(0, first - self.beside) : first][::-1], text[end : end + self.beside]
                for left, right, items in sides:
                    a, b = same(left, before), same(right, after)
                    if a + b >= self.beside:
                        out.append((first - a, a + n + b, items))
        return out


class Benchmark:
    """The blocks of one pass.  A sole automaton is built once in each Python worker, several are built in turn for a group of texts."""

    def __init__(self, blocks: list[list[tuple[str, bytes]]], width: int = WIDTH):
        self.blocks, self.width, self.sole = blocks, width, None

    def __getstate__(self) -> dict:
        return {"blocks": self.blocks, "width": self.width, "sole": None}

    def automata(self) -> Iterator[Automaton]:
        if len(self.blocks) > 1:
            yield from (Automaton(b, self.width) for b in self.blocks)
        elif self.blocks:
            self.sole = self.sole or Automaton(self.blocks[0], self.width)
            yield self.sole

    def hits(self, texts: list[bytes]) -> list[list[tuple[int, int, tuple[str, ...]]]]:
        out = [[] for _ in texts]
        for automaton in self.automata():
            for found, text in zip(out, texts, strict=True):
                found += automaton.hits(words_of(text))
        return out

    def groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        """Batches that are scanned together: each alone for a sole automaton, else some megabytes."""
        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.nbytes
            if len(self.blocks) < 2 or size >= GROUP_BYTES:
                yield group
                group, size = [], 0
        if group:
            yield group


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint [start, end) ranges that cover the same words."""
    out: list[list[int]] = []
    for a, n in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of ranges of words."""
    if not ranges:
        return []
    flat = np.frombuffer(text.translate(WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(points[edge[2 * a]]), int(points[edge[2 * b - 1]])) for a, b in ranges]


RANGES = "struct<found: array<struct<a: bigint, n: bigint>>, items: array<string>>"
HIT = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: bigint, end: bigint>>, contaminated: boolean>"


def verdict(text: bytes, found: list[tuple[int, int]], items: set[str]) -> dict:
    n_words, ranges = len(words_of(text)), merged(found)
    n_hit = sum(b - a for a, b in ranges)
    spans = [{"start": a, "end": b} for a, b in offsets(text, ranges)]
    return {"n_words": n_words, "n_hit": n_hit, "items": sorted(items), "spans": spans, "contaminated": n_hit > 0 and 20 * n_hit >= n_words}


def scanned(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, max_words: int = MAX_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with a struct ``__hit``: n_words, n_hit, items (sorted), spans in the original text, contaminated.

    One pass over the documents for every ``pass_bytes`` of benchmark text; an
    earlier pass stores its hits beside the texts.
    """
    kind = to_arrow_schema(T.StructType.fromDDL(f"h {HIT}")).field(0).type
    found_kind = to_arrow_schema(T.StructType.fromDDL(f"h {RANGES}")).field(0).type
    context = docs.sparkSession.sparkContext
    own, past, now = docs.columns, [], docs
    if "__hit" in own:
        raise ValueError("documents have a column __hit already")
    every = passes(blocks(items, item_id, item_text, width, max_words), pass_bytes)
    part = next(every, [])
    for following in every:
        shared = context.broadcast(Benchmark(part, width))
        past.append(next(x for i in count(len(past)) if (x := f"__found{i}") not in own and x not in past))
        kept = T.StructType([*now.schema.fields, *T.StructType.fromDDL(f"{past[-1]} {RANGES}").fields])
        now = stored(now.mapInArrow(collecting(shared, now.columns.index(text), kept.names, found_kind), kept), "hits")
        shared.destroy()
        part = following
    last = context.broadcast(Benchmark(part, width))
    at = now.columns.index(text)
    earlier = [now.columns.index(x) for x in past]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, hits in with_hits(last.value, at, batches):
            before = [batch.column(k).to_pylist() for k in earlier]
            out = []
            for r, (t, own_hits) in enumerate(zip(texts, hits, strict=True)):
                found = [(a, n) for a, n, _ in own_hits] + [(x["a"], x["n"]) for b in before for x in b[r]["found"]]
                out.append(verdict(t, found, {i for h in own_hits for i in h[2]} | {i for b in before for i in b[r]["items"]}))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(out, kind)], names=[*own, "__hit"])

    small_batches(docs.sparkSession)
    return now.mapInArrow(finish, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"__hit {HIT}").fields]))


def with_hits(benchmark: Benchmark, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[tuple[int, int, tuple[str, ...]]]]]]:
    """Each batch with its texts and their hits."""
    for group in benchmark.groups(batches):
        texts = [[t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()] for batch in group]
        hits = iter(benchmark.hits([t for batch in texts for t in batch]))
        for batch, own in zip(group, texts, strict=True):
            yield batch, own, list(islice(hits, len(own)))


def collecting(shared: Broadcast, at: int, names: list[str], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow map that adds the hits of one pass as a last column."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, hits in with_hits(shared.value, at, batches):
            rows = [{"found": [{"a": a, "n": b - a} for a, b in merged([x[:2] for x in h])], "items": sorted({i for x in h for i in x[2]})} for h in hits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=names)

    return collect


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    h = F.col("__hit")
    return scanned(docs, items).select(
        "doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(h["items"], ",").cast("binary"), 256).alias("items_sha256"), h["contaminated"].alias("contaminated")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, with the columns they came with."""
    return scanned(docs, table(spark, sf_dir, "benchmark")).where("not __hit.contaminated").drop("__hit")
