"""Language-model scores: prediction by partial matching over a byte-context trie.

The trie is a table with a row per context: its successors and their counts in
the training texts, for contexts of ``order`` bytes and all their suffixes.  A
byte is coded in its longest known context; if it is new there, an escape
(method D: half a count is kept back for each distinct successor) leads to the next shorter
one, and successors already ruled out are excluded.  Below order zero all bytes
left are equally likely.  Each text is coded with an end symbol.

No part of the model goes to the driver or to every task.  Documents lie in
chunks of about ``chunk_bytes``; each chunk is sent the contexts and words that
occur in it, with their counts over all chunks, and scores its own documents.
Counts meet in levels: at each one, groups of ``FAN`` times as many chunks
settle ``FAN`` times narrower ranges of hashes, so every node hears of about
``FAN`` others, and rows grow with the chunks times the number of levels.

Defined cases.  A null or empty text is its end alone.  A null doc_id trains.
Repeated rows train as often as they occur and are each scored.  With no
training documents, nothing is known and all bytes are equally likely.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import LOWER, small_batches, stored, table

ORDER = 5
CHUNK_BYTES = 32 << 20
#: Bytes that are coded at once inside a chunk.
STEP_BYTES = 4 << 20
#: Neither byte occurs in UTF-8: one stands before a text, the other ends it.
START, END = b"\xfe", b"\xff"
#: The end token, which no word can be, as it is white space.
END_TOKEN = b"\n"
#: The kind of a row of words; rows of grams have the length of their contexts.
WORDS = -1
#: A node of one level hears of so many of the level below: a power of two, as buckets are leading bits of a hash.
FAN = 64
HASH_BITS = 31
#: Words are known by 64-bit hashes, grams by their bytes as a number; counts take eight bytes, too.
#: ``src`` is the chunk, or the group of chunks, that a row comes from or goes to.
ROWS = "src bigint, kind int, bucket bigint, keys binary, ns binary"
TOTALS = "src bigint, kind int, bucket bigint, keys binary, ns binary, known bigint, total bigint"
#: What a chunk returns: a row per document, and one with the sums over the words that it heads.
PARTS = "totals boolean, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``chunk, doc_id, held_out, t``, stored: neighbours lie in one chunk until it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.array([len(t) for t in batch.column(2).to_pylist()], np.int64)
            before = done + np.cumsum(sizes) - sizes
            done += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(first + before // chunk_bytes), *batch.columns], names=["chunk", "doc_id", "held_out", "t"])

    small_batches(docs.sparkSession)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t"))
    return stored(slim.mapInArrow(run, "chunk bigint, doc_id bigint, held_out boolean, t binary"), "chunks")


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    a = size = 0
    for b, t in enumerate(texts):
        if size + len(t) > most and b > a:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The number of every context with its byte, and where each text's begin.  A text of n bytes has n + 1."""
    row = np.frombuffer(b"".join(START * order + t + END for t in texts), np.uint8)
    n = len(row) - order
    key = np.zeros(n, np.int64)
    for j in range(order + 1):
        key = (key << 8) | row[j : j + n]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(lengths + order) - order
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[e : e + order] = False
    return key[inside], np.cumsum(lengths) - lengths


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` of a hash: buckets of more bits lie within those of fewer."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)) >> np.uint64(HASH_BITS - bits)


def squeezed(keys: np.ndarray) -> bytes:
    """Keys in order as their differences, deflated."""
    return zlib.compress(np.diff(keys, prepend=np.int64(0)).astype("<i8").tobytes(), 1)


def spread(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), "<i8"))


def packed(kind: int, keys: np.ndarray, n: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(kind, bucket, keys, counts) with keys in order within each bucket; grams of one context lie in one bucket."""
    b = bucket_of(keys if kind == WORDS else (keys >> 8) + kind, bits)
    order = np.lexsort((keys, b))
    b, keys, n = b[order], keys[order], n[order]
    cuts = [*np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))).tolist(), len(b)] if len(b) else [0]
    for x, y in zip(cuts, cuts[1:]):
        yield kind, int(b[x]), squeezed(keys[x:y]), n[x:y].astype("<i8").tobytes()


def shorter(gram: np.ndarray, n: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(context length, grams, counts) from ``order`` down: grams of shorter contexts are sums over longer ones."""
    for j in range(order, -1, -1):
        gram, at = np.unique(gram & ((1 << (8 * (j + 1))) - 1), return_inverse=True)
        n = np.bincount(at, n).astype(np.int64) if len(gram) else n
        yield j, gram, n


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def batch_of(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of columns that are all ``bigint``, ``int`` or ``binary``."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    cols = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def counted(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """``ROWS``: each chunk's words and grams, packed by bucket, with their training counts; held-out texts alone count nothing."""

    def rows(chunk: int, words: Counter, found: Counter) -> pa.RecordBatch:
        n = np.fromiter(words.values(), np.int64, len(words))
        keys = word_keys(list(words))
        every = list(packed(WORDS, keys, n, bits))
        gram = np.fromiter(found.keys(), np.int64, len(found))
        for j, g, m in shorter(gram, np.fromiter(found.values(), np.int64, len(found)), order):
            every += packed(j, g, m, bits)
        return batch_of(ROWS, [(chunk, *x) for x in every])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, found = None, Counter(), Counter()
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now != chunk[a]:
                    if now is not None:
                        yield rows(now, words, found)
                    now, words, found = int(chunk[a]), Counter(), Counter()
                for held in (False, True):
                    texts = [t for t, h in zip(batch.column(3)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist(), strict=True) if h == held]
                    for t in texts:
                        w = t.translate(LOWER).split()
                        if held:
                            words.update(dict.fromkeys(w, 0))
                        else:
                            words.update(w)
                    words[END_TOKEN] += 0 if held else len(texts)
                    for p, q in steps(texts):
                        codes, distinct = pd.factorize(grams(texts[p:q], order)[0])
                        sizes = np.zeros(len(distinct), np.int64) if held else np.bincount(codes)
                        found.update(dict(zip(distinct.tolist(), sizes.tolist(), strict=True)))
        if now is not None:
            yield rows(now, words, found)

    return chunks.mapInArrow(run, ROWS)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i8")


Part = tuple[int, bytes, bytes]


def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[Part]]]:
    """((group, kind, bucket), its parts (src, keys, counts)) of rows sorted so."""
    now, parts = None, []
    for batch in batches:
        for group, src, kind, bucket, keys, ns in zip(*(batch.column(c).to_pylist() for c in ("group", "src", "kind", "bucket", "keys", "ns")), strict=True):
            if (group, kind, bucket) != now:
                if now is not None:
                    yield now, parts
                now, parts = (group, kind, bucket), []
            parts.append((src, keys, ns))
    if now is not None:
        yield now, parts


def summed(parts: list[Part]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their counts over all parts."""
    keys, at = np.unique(np.concatenate([spread(k) for _, k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([unpacked(n) for _, _, n in parts])).astype(np.int64)


def answers(kind: int, parts: list[Part], keys: np.ndarray, total: np.ndarray, head: list[int]) -> Iterator[tuple]:
    """(src, keys, counts, known, total): each part gets its words, and every gram whose context it has; the first gets ``head``."""
    mine: dict[int, list[np.ndarray]] = {}
    for src, k, _ in parts:
        mine.setdefault(src, []).append(spread(k))
    for src, lists in mine.items():
        held = np.unique(np.concatenate(lists))
        take = np.searchsorted(keys, held) if kind == WORDS else np.flatnonzero((total > 0) & np.isin(keys >> 8, np.unique(held >> 8)))
        yield src, squeezed(keys[take]), total[take].tobytes(), *head
        head = [0, 0]


def merged(rows: DataFrame, levels: int, bits: int) -> DataFrame:
    """``rows`` with counts over all chunks, sent back to them (``TOTALS``).

    On the way up, a node sums what it hears and passes it on, split into narrower buckets;
    the highest level has all counts.  On the way down, each node deals what it is
    sent to those that it heard.  ``known`` and ``total`` tell a bucket's known
    words and their sum to one chunk.
    """

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("group", "kind", "bucket").sortWithinPartitions("group", "kind", "bucket", "src")

    def pass_on(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (group, kind, _), parts in nodes(batches):
                yield batch_of(ROWS, [(group, *x) for x in packed(kind, *summed(parts), bits * (level + 1))])

        return run

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, kind, bucket), parts in nodes(batches):
            keys, total = summed(parts)
            head = [int((total > 0).sum()), int(total.sum())] if kind == WORDS else [0, 0]
            yield batch_of(TOTALS, [(src, kind, bucket >> bits, *rest) for src, *rest in answers(kind, parts, keys, total, head)])

    def pass_back(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, bucket = left["kind"][0].as_py(), left["bucket"][0].as_py()
        parts = list(zip(*(left[c].to_pylist() for c in ("src", "keys", "ns")), strict=True))
        keys = np.concatenate([spread(k) for k in right["keys"].to_pylist()])
        total = np.concatenate([unpacked(n) for n in right["ns"].to_pylist()])
        order = np.argsort(keys)
        head = [sum(right[c].to_pylist()) for c in ("known", "total")]
        return pa.Table.from_batches([batch_of(TOTALS, [(src, kind, bucket >> bits, *rest) for src, *rest in answers(kind, parts, keys[order], total[order], head)])])

    slot = F.pmod(F.xxhash64("src"), F.lit(1 << (bits * levels)))
    heard, rows = [], rows.withColumn("group", F.shiftright(slot, bits))
    for level in range(1, levels):
        heard.append(stored(rows, "counts"))
        rows = dealt(heard[-1]).mapInArrow(pass_on(level), ROWS).withColumn("group", F.shiftright("src", bits))
    totals = dealt(rows).mapInArrow(settle, TOTALS)
    for rows in reversed(heard):
        totals = rows.groupBy("group", "kind", "bucket").cogroup(totals.groupBy("src", "kind", "bucket")).applyInArrow(pass_back, TOTALS)
    return totals


class Model:
    """The part of the trie that a chunk needs: for each context length, grams in order and their counts."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.order, self.levels, self.nodes, self.known = order, levels, {}, {}

    @classmethod
    def of(cls, found: dict[int, int], order: int = ORDER) -> "Model":
        """The model of counted grams."""
        g, n = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
        return cls({j: (a[m > 0], m[m > 0]) for j, a, m in shorter(g, n, order)}, order)

    def node(self, j: int, ctx: int) -> dict[int, int]:
        """The successors of a context of ``j`` bytes with their counts."""
        key = (j, ctx)
        if key not in self.nodes:
            grams, n = self.levels.get(j, (np.zeros(0, np.int64),) * 2)
            a, b = np.searchsorted(grams, [ctx << 8, (ctx + 1) << 8])
            self.nodes[key] = dict(zip((grams[a:b] & 255).tolist(), n[a:b].tolist(), strict=True))
        return self.nodes[key]

    def code_length(self, gram: int) -> float:
        """log10 of the probability of the last byte of ``gram`` after the others."""
        if gram in self.known:
            return self.known[gram]
        sym, ctx, out, score = gram & 255, gram >> 8, set(), 0.0
        for j in range(self.order, -1, -1):
            node = self.node(j, ctx & ((1 << (8 * j)) - 1))
            live = {s: n for s, n in node.items() if s not in out} if out else node
            if not live:
                continue
            total = 2 * sum(live.values())
            if sym in live:
                score += math.log10((2 * live[sym] - 1) / total)
                break
            score += math.log10(len(live) / total)
            out |= live.keys()
        else:
            score -= math.log10(max(1, 256 - len(out)))
        self.known[gram] = score
        return score

    def code_lengths(self, grams: np.ndarray) -> np.ndarray:
        """Those of distinct grams; the ones known in their longest context are looked up together."""
        have, n = self.levels.get(self.order, (np.zeros(0, np.int64),) * 2)
        out = np.zeros(len(grams))
        at = np.searchsorted(have, grams)
        seen = np.zeros(len(grams), bool)
        if len(have):
            seen = have[np.minimum(at, len(have) - 1)] == grams
            first = np.flatnonzero(np.concatenate(([True], (have[1:] >> 8) != (have[:-1] >> 8))))
            total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(have))))
            out[seen] = np.log10((2 * n[at[seen]] - 1) / (2 * total[at[seen]]))
        out[~seen] = [self.code_length(k) for k in grams[~seen].tolist()]
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        found: list[float] = []
        for a, b in steps(texts):
            key, first = grams(texts[a:b], self.order)
            codes, distinct = pd.factorize(key)
            found += np.add.reduceat(self.code_lengths(distinct)[codes], first).tolist()
        return found


def scored(docs: DataFrame, order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    chunks = chunked(docs, chunk_bytes)
    n_chunks, bits, levels = chunks.select("chunk").distinct().count(), fan.bit_length() - 1, 1
    while fan**levels < n_chunks:
        levels += 1
    known = merged(counted(chunks, order, bits), levels, bits)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        lists: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for kind, keys, ns in zip(*(right[c].to_pylist() for c in ("kind", "keys", "ns")), strict=True):
            lists.setdefault(kind, []).append((spread(keys), unpacked(ns)))
        levels = {}
        for kind, parts in lists.items():
            keys, n = (np.concatenate(x) for x in zip(*parts))
            order_ = np.argsort(keys, kind="stable")
            levels[kind] = keys[order_], n[order_]
        word, n = levels.pop(WORDS)
        log = np.log10(n + 1.0)
        texts = left["t"].to_pylist()
        n_tokens, n_known, base = [sum(right["total"].to_pylist())], [sum(right["known"].to_pylist())], [0.0]
        for a, b in steps(texts):
            lists_ = [[*t.translate(LOWER).split(), END_TOKEN] for t in texts[a:b]]
            flat = np.empty(sum(map(len, lists_)), object)
            flat[:] = [w for x in lists_ for w in x]
            codes, distinct = pd.factorize(flat)
            each = log[np.searchsorted(word, word_keys(distinct))][codes]
            sizes = np.array(list(map(len, lists_)))
            first = np.cumsum(sizes) - sizes
            n_tokens += sizes.tolist()
            n_known += np.add.reduceat((each > 0).astype(np.int64), first).tolist()
            base += np.add.reduceat(each, first).tolist()
        cols = [[True] + [False] * len(texts), [None, *left["doc_id"].to_pylist()], [None, *left["held_out"].to_pylist()], n_tokens, n_known, base, [0.0, *Model(levels, order).scores(texts)]]
        kinds = [pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PARTS.split(", ")])

    parts = stored(chunks.groupBy("chunk").cogroup(known.groupBy("src")).applyInArrow(score, PARTS), "scores")
    n_train, n_distinct = (int(x or 0) for x in parts.where("totals").agg(F.sum("n_tokens"), F.sum("n_known")).first())
    base = F.col("base") - F.col("n_tokens") * math.log10(n_train + n_distinct + 1)
    return parts.where("not totals").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
