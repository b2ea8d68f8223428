"""Line deduplication: an exact set-similarity join over the words of lines.

A line takes part if it has a word.  It is removed if an earlier one (smaller
doc_id, or the same document further up) has a Jaccard similarity of at least
4/5 to it; both are judged on the input.

Lines with equal word sets are one class, known by its first line.  The words
of a class are ordered by rarity; only its prefix enters the inverted index,
without words that no other line has.  Postings travel as packed columns, one
row for each bucket of words.  Classes that meet in a posting list pass the
length filter (lists are sorted by size, and a class looks only as far as sizes
allow), the positional filter and a bound on their difference by bits of parity; what is
left is verified on whole word sets.  Rarity comes from a table of ``SLOTS``
hashed counts, whose size is fixed: it sets the order only, never the result.

The first round verifies the nearest earlier candidate of each class, so a family
of similar lines costs a pair a line, not all pairs.  Classes that it does not
match and that had further candidates go to a second round, where all their
candidates are verified.  Words that more than ``BLOCK``
lines may have are posted row by row; their lists are cut into blocks that are
compared block against block in tasks of their own.

Words are told apart by 48 bits of a hash, sets of words by 128.

Defined cases.  A null text has no lines and stays null; an empty text stays
empty.  Lines without words are kept.  Rows that repeat a doc_id and a text are
one document and keep the same lines; different texts of one doc_id are documents
of their own, in the order of their hashes.  Documents with a null doc_id are
left alone.  Very long texts are hashed in steps; a line is held as a whole.
Columns of the input travel in one struct, so their names can't clash.  An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import bucketed, discard, map_rows, small_batches, stored, table
from caseloom.llm.words import hashed

#: Hashed counts, one byte each when sent to the tasks: a bound of 32 MB.
SLOTS, SLICES, PARTS = 1 << 25, 64, 16
BLOCK = 4096
#: Words that are counted, and postings that are sent, at a time.
COUNTED, POSTED = 1 << 22, 1 << 20
#: Postings of a bucket, on average.
BUCKET = 1 << 16
#: Lines of more words have a bitmap of twice the bits.
LARGE = 32
#: A table of words of at most so many rows is sent to all tasks; a longer one is joined.
SMALL = 200_000
#: ASCII white space.
BLANK = " \t\n\x0b\x0c\r"
#: Turns six bytes into a number.
BYTES = np.array([1 << (8 * k) for k in range(6)], np.int64)
POSTINGS = ["word", "doc", "place", "n", "rank", "bits", "bits2"]
PACKED = "bucket int, size int, word binary, base bigint, doc binary, place binary, n binary, rank binary, bits binary, bits2 binary, probe boolean"
LOOSE = "word bigint, doc bigint, place bigint, n int, rank int, bits bigint, bits2 bigint"
NEAR = "doc bigint, place bigint, doc2 bigint, place2 bigint, far int, more boolean"


class Lines:
    """The lines with words of some texts: text, line number, and the distinct words of each in ascending order of their hashes."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join([*texts, b""])
        at, h = hashed(data)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        line = np.searchsorted(breaks, at)
        pieces = []
        for low in range(0, len(breaks), 1 << 16):
            a, b = np.searchsorted(line, [low, low + (1 << 16)])
            key = np.sort(((line[a:b] - low).astype(np.uint64) << np.uint64(48)) | (h[a:b] >> np.uint64(16)))
            if len(key):
                key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            pieces.append(((key >> np.uint64(48)).astype(np.int64) + low, key & np.uint64((1 << 48) - 1)))
        line = np.concatenate([p[0] for p in pieces])
        self.word = np.concatenate([p[1] for p in pieces])
        self.full, self.first, self.n = np.unique(line, return_index=True, return_counts=True)
        self.before = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
        self.doc = np.searchsorted(self.before, self.full, "right") - 1
        self.number = self.full - self.before[self.doc]
        self.line = np.repeat(np.arange(len(self.full)), self.n)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(k)
    return h ^ (h >> np.uint64(29))


def deflated(slots: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending slots as differences, and their counts, by planes of bytes."""
    both = np.concatenate((np.diff(slots, prepend=0), n)).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def inflated(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int64), both[half:]


def places(batch: pa.RecordBatch, x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, its document and its place: the document's version, then the line's number."""
    return batch.column(0).to_numpy()[x.doc], (batch.column(1).to_numpy()[x.doc].astype(np.int64) << 32) | x.number


def picked(batch: pa.RecordBatch) -> tuple[Lines, np.ndarray, np.ndarray]:
    """The lines named in the batch's fourth column, with their documents and places."""
    texts, doc, place = [], [], []
    for d, v, t, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        own = [p for p in some if p >> 32 == v]
        if own:
            rows = t.split(b"\n")
            texts += [rows[p & 0xFFFFFFFF] for p in own]
            doc += [d] * len(own)
            place += own
    x = Lines(texts)
    return x, np.array(doc, np.int64)[x.doc], np.array(place, np.int64)[x.doc]


def measured(docs: DataFrame) -> DataFrame:
    """A stored table of two kinds of rows: ``s1, s2, doc, place`` of every line, and ``slice, counts`` of the words in hashed slots.

    A word counts once for each word set among the lines that a task looks at together.
    """
    width = SLOTS // SLICES
    schema = "s1 bigint, s2 bigint, doc bigint, place bigint, slice int, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]

    def counted(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        s, n, words = (np.concatenate(x) for x in zip(*held))
        once = np.zeros(len(s), bool)
        once[np.unique(s, return_index=True)[1]] = True
        slot, count = np.unique(words[np.repeat(once, n)] % np.uint64(SLOTS), return_counts=True)
        cut = np.searchsorted(slot, np.arange(SLICES + 1) * width)
        rows = [k for k in range(SLICES) if cut[k] < cut[k + 1]]
        blobs = [deflated((slot[cut[k] : cut[k + 1]] - np.uint64(k * width)).astype(np.int64), count[cut[k] : cut[k + 1]]) for k in rows]
        none = [pa.nulls(len(rows), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*none, pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            x = Lines(batch.column(2).to_pylist())
            if not len(x.n):
                continue
            s1, s2 = (np.add.reduceat(mixed(x.word, k), x.first) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (s1, s2)] + [pa.array(c) for c in places(batch, x)] + [pa.nulls(len(s1), k) for k in kinds[4:]], names=names)
            held.append((s1, x.n, x.word))
            size += len(x.word)
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return stored(docs.mapInArrow(run, schema), "line-measures")


def rarity(found: DataFrame) -> np.ndarray:
    """For each slot, how many lines have a word there, on a scale of one byte: 0, 1, then logarithmic and rounded up."""
    width = SLOTS // SLICES

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                slots, n = inflated(counts)
                sums.setdefault(k, np.zeros(width, np.int64))[slots] += n
        return iter(sums.items())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, own in summed(batches):
            slots = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([deflated(slots, np.minimum(own[slots], (1 << 32) - 1))], pa.binary())], names=["slice", "counts"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, own in summed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([scaled(own).tobytes()], pa.binary())], names=["slice", "scale"])

    counts = found.where("slice is not null").select("slice", "counts")
    some = counts.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(PARTS))).repartition("slice", "part").select("slice", "counts").mapInArrow(part, "slice int, counts binary")
    out = np.zeros(SLOTS, np.uint8)
    for row in some.repartition(SLICES, "slice").mapInArrow(whole, "slice int, scale binary").collect():  # SLOTS bytes in all
        out[row[0] * width : (row[0] + 1) * width] = np.frombuffer(bytes(row[1]), np.uint8)
    return out


def scaled(n: np.ndarray) -> np.ndarray:
    return np.where(n < 2, n, np.minimum(255, 2 + np.ceil(7 * np.log2(np.maximum(n, 2) - 1)))).astype(np.uint8)


def parities(x: Lines) -> tuple[np.ndarray, np.ndarray]:
    """For each line, how many of its words fall on each of 64 bits, odd or even; of large lines, on each of 128.

    Sets that differ in d words differ in at most d bits.  The exclusive or of the two halves is what 64 bits give.
    """
    h = mixed(x.word, 0x9E3779B97F4A7C15)
    bit = np.uint64(1) << (h >> np.uint64(58))
    high = (x.n > LARGE)[x.line] & ((h >> np.uint64(57)) & np.uint64(1)).astype(bool)
    return np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), x.first), np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), x.first)


def prefix(n: np.ndarray) -> np.ndarray:
    """How many of ``n`` ordered words two sets must share one of, to be as similar as 4/5."""
    return n - (4 * n + 4) // 5 + 1


def narrow(a: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()))).tobytes()


def wide(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // size}").astype(np.int64)


def posted(docs: DataFrame, scale: object, hot: int, buckets: int, probe: bool) -> tuple[DataFrame, DataFrame]:
    """The postings of the lines ``places`` of ``docs`` (doc_id, version, t, places): packed by bucket, and loose for words of which more than ``hot`` on the scale."""
    packed, loose = T.StructType.fromDDL(PACKED), T.StructType.fromDDL(LOOSE)
    names = [*packed.names, *[f"l_{c}" for c in loose.names]]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), *[pa.binary()] * 6, pa.bool_(), *[pa.int64()] * 3, pa.int32(), pa.int32(), *[pa.int64()] * 2]
    schema = T.StructType([*packed.fields, *[T.StructField(f"l_{f.name}", f.dataType) for f in loose.fields]])

    def sent(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        word, doc, place, n, rank, bits, more, often = (np.concatenate(x) for x in zip(*held))
        at = np.flatnonzero(often)
        if len(at):
            cols = [word[at].view(np.int64), doc[at], place[at], n[at], rank[at], bits[at].view(np.int64), more[at].view(np.int64)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(at), k) for k in kinds[:11]], *[pa.array(c, k) for c, k in zip(cols, kinds[11:], strict=True)]], names=names)
        bucket = (word % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        order = order[~often[order]]
        if not len(order):
            return
        cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]))
        rows: list[list] = [[] for _ in kinds[:11]]
        for a, b in zip(cut.tolist(), cut[1:].tolist()):
            i = order[a:b]
            base = int(doc[i].min())
            cells = (int(bucket[i[0]]), b - a, (word[i] >> np.uint64(16)).astype("<u4").tobytes(), base, narrow((doc[i] - base).view(np.uint64)), narrow(place[i]), narrow(n[i]), narrow(rank[i]), bits[i].tobytes(), more[i].tobytes(), probe)
            for r, x in zip(rows, cells, strict=True):
                r.append(x)
        yield pa.RecordBatch.from_arrays([*[pa.array(r, k) for r, k in zip(rows, kinds, strict=False)], *[pa.nulls(len(rows[0]), k) for k in kinds[11:]]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            x, doc, place = picked(batch)
            if not len(x.n):
                continue
            rare = scale.value[x.word % np.uint64(SLOTS)]
            order = np.lexsort((rare, x.line))
            word, rare = x.word[order], rare[order]
            rank = np.arange(len(word)) - x.first[x.line]
            pick = (rank < prefix(x.n)[x.line]) & (rare > 1)
            bits, more = parities(x)
            line = x.line[pick]
            held.append([word[pick], doc[line], place[line], x.n[line], rank[pick], bits[line], more[line], rare[pick] > hot])
            size += len(line)
            if size >= POSTED:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    every = stored(docs.mapInArrow(run, schema), "postings")
    return every.where("bucket is not null").select(*packed.names), every.where("l_word is not null").select(*[F.col(f"l_{c}").alias(c) for c in loose.names])


def met(x: dict[str, np.ndarray], group: np.ndarray, is_open: np.ndarray | None) -> pa.RecordBatch | None:
    """Candidates within groups of equal words: of each row the nearest earlier one, or of each open row all earlier ones."""
    order = np.lexsort((x["n"], group))
    group = group[order]
    x = {k: v[order] for k, v in x.items()}
    is_open = None if is_open is None else is_open[order]
    m = len(group)
    age = np.empty(m, np.int64)
    by_age = np.lexsort((x["place"], x["doc"]))
    age[by_age] = np.cumsum(np.concatenate(([0], (np.diff(x["doc"][by_age]) != 0) | (np.diff(x["place"][by_age]) != 0)))) if m else 0
    start = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(m), 0))
    depth = np.arange(m) - start
    best, near, count = np.full(m, 255, np.uint8), np.full(m, -1, np.int64), np.zeros(m, np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    a, k = np.arange(m), 0
    while True:
        k += 1
        a = a[depth[a] >= k]
        a = a[5 * x["n"][a - k] >= 4 * x["n"][a]]
        if not len(a):
            break
        b = a - k
        both = x["n"][a] + x["n"][b]
        need = (4 * both + 8) // 9
        ok = np.minimum(x["n"][a] - x["rank"][a], x["n"][b] - x["rank"][b]) >= need
        low, high = x["bits"][a] ^ x["bits"][b], x["bits2"][a] ^ x["bits2"][b]
        diff = np.where(x["n"][b] > LARGE, np.bitwise_count(low) + np.bitwise_count(high), np.bitwise_count(low ^ high))
        ok &= (diff <= both - 2 * need) & (age[a] != age[b])
        u, v, d = a[ok], b[ok], diff[ok]
        new = age[u] > age[v]
        for later, earlier, far in ((u[new], v[new], d[new]), (v[~new], u[~new], d[~new])):
            if is_open is not None:
                keep = is_open[later]
                pairs.append((later[keep], earlier[keep]))
                continue
            count[later] += 1
            nearer = (far < best[later]) | ((far == best[later]) & (age[earlier] < age[near[later]]))
            best[later[nearer]], near[later[nearer]] = far[nearer], earlier[nearer]
    if is_open is None:
        pairs = [(np.flatnonzero(near >= 0), near[near >= 0])]
    u, v = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    if not len(u):
        return None
    cols = [x["doc"][u], x["place"][u], x["doc"][v], x["place"][v], best[u].astype(np.int32), count[u] > 1]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "place", "doc2", "place2", "far", "more"])


def in_buckets(only_open: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates in packed postings; rows come sorted by bucket.  With ``only_open``, probes mark the open rows."""

    def opened(rows: list[dict]) -> pa.RecordBatch | None:
        cols: dict[str, list] = {c: [] for c in [*POSTINGS, "probe"]}
        for r in rows:
            k = r["size"]
            cols["word"].append(np.frombuffer(r["word"], "<u4"))
            cols["doc"].append(wide(r["doc"], k) + r["base"])
            for c in ("bits", "bits2"):
                cols[c].append(np.frombuffer(r[c], "<u8"))
            cols["probe"].append(np.full(k, r["probe"]))
            for c in ("place", "n", "rank"):
                cols[c].append(wide(r[c], k))
        x = {c: np.concatenate(v) for c, v in cols.items()}
        group, probe = x.pop("word"), x.pop("probe")
        if not only_open:
            return met(x, group, None)
        return probed(x, group, probe) if probe.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    if (out := opened(held)) is not None:
                        yield out
                    held = []
                held.append(r)
        if held and (out := opened(held)) is not None:
            yield out

    return run


def probed(x: dict[str, np.ndarray], group: np.ndarray, probe: np.ndarray) -> pa.RecordBatch | None:
    """:func:`met` for the rows that probes repeat."""
    order = np.lexsort((probe, x["place"], x["doc"], group))
    same = (np.diff(group[order]) == 0) & (np.diff(x["doc"][order]) == 0) & (np.diff(x["place"][order]) == 0)
    mark = np.concatenate((same & probe[order][1:], [False]))
    stay = ~probe[order]
    return met({c: v[order][stay] for c, v in x.items()}, group[order][stay], mark[stay])


def in_runs(only_open: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates in loose postings; rows come sorted by ``word, lo, hi`` and a run of equal ones is a block against a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            change = np.concatenate(([False], np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)))
            x = dict(zip(POSTINGS[1:], cols[3:9], strict=True))
            found = met(x | {"bits": x["bits"].view(np.uint64), "bits2": x["bits2"].view(np.uint64), "n": x["n"].astype(np.int64)}, np.cumsum(change), cols[9] if only_open else None)
            if found is not None:
                yield found

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:
                yield from out([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield from out(held)

    return run


def few(words: DataFrame) -> DataFrame:
    """A stored table of words, marked for sending to all tasks if a count shows it to be small."""
    words = stored(words, "words")
    return F.broadcast(words) if words.count() <= SMALL else words


def in_blocks(loose: DataFrame, long: DataFrame, is_open: DataFrame | None) -> DataFrame:
    """Candidates in ``loose`` postings: rows dealt by word, those of ``long`` words once for each block that theirs is compared with."""
    marked = loose.withColumn("is_open", F.lit(False)) if is_open is None else loose.join(is_open.withColumn("is_open", F.lit(True)), ["doc", "place"], "left").withColumn("is_open", F.coalesce("is_open", F.lit(False)))
    dealt = marked.join(long, "word", "left").withColumn("k", F.coalesce(F.ceil(F.col("count") / BLOCK).cast("int"), F.lit(1)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("doc", "place"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("word", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi"), *POSTINGS[1:], "is_open")
    return dealt.repartition("word", "lo", "hi").sortWithinPartitions("word", "lo", "hi").mapInArrow(in_runs(is_open is not None), NEAR)


def candidates(packed: DataFrame, loose: DataFrame, long: DataFrame, is_open: DataFrame | None = None) -> DataFrame:
    near = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(in_buckets(is_open is not None), NEAR)
    return near.unionByName(in_blocks(loose, long, is_open))


def word_sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc, place, set`` of the ``wanted`` lines (doc, place), told from the texts."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        x, doc, place = picked(batch)
        ends = np.cumsum(x.n).tolist()
        packed = np.ascontiguousarray(x.word.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
        yield {"doc": doc, "place": place, "set": [packed[6 * a : 6 * b] for a, b in zip([0, *ends], ends)]}

    found = map_rows(named(docs, wanted), "doc bigint, place bigint, set binary", run)
    return stored(found.dropDuplicates(["doc", "place"]), "line-sets")


def by_doc(lines: DataFrame) -> DataFrame:
    """``doc_id, places``: one row per doc_id of ``lines``."""
    return lines.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("place").alias("places"))


def named(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have some of ``lines``, with ``places``; the lists are hashed, so that texts are not sorted."""
    return docs.join(by_doc(lines).hint("shuffle_hash"), "doc_id")


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, place`` of lines with enough shared words with one of their candidates; rows come sorted by line, its own set first."""
    now, own = None, b""
    for batch in batches:
        found = []
        for doc, place, is_own, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if is_own:
                now, own = (doc, place), words
            elif now is not None:
                both = np.sort(np.frombuffer(own + words, "V6").view(np.uint8).reshape(-1, 6) @ BYTES)
                if 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both):
                    found.append(now)
                    now = None  # the rest can't add to it
        cols = zip(*found) if found else [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "place"])


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored ``doc, place`` of the later lines of ``pairs`` (doc, place, doc2, place2) whose word sets are as similar as 4/5."""
    asked = pairs.select("doc", "place").distinct()
    found = word_sets(asked.union(pairs.select("doc2", "place2")), docs)
    other = found.select(F.col("doc").alias("doc2"), F.col("place").alias("place2"), "set")
    rows = pairs.join(other, ["doc2", "place2"]).select("doc", "place", F.lit(False).alias("own"), "set")
    rows = rows.unionByName(found.join(asked, ["doc", "place"], "left_semi").withColumn("own", F.lit(True)))
    met = rows.repartition("doc", "place").sortWithinPartitions("doc", "place", F.desc("own")).select("doc", "place", "own", "set")
    hit = stored(met.mapInArrow(alike, "doc bigint, place bigint"), "lines-hit")
    discard(found)
    return hit


def first_lines(docs: DataFrame) -> DataFrame:
    """``doc, place`` of the lines of ``docs`` (doc_id, version, t; bucketed by doc_id) that have no similar line before them."""
    found = measured(docs)
    scale = docs.sparkSession.sparkContext.broadcast(rarity(found))
    head = found.where("slice is null").groupBy("s1", "s2").agg(F.min(F.struct("doc", "place")).alias("c"))
    heads = stored(head.select("c.*"), "line-heads")
    discard(found)
    buckets = max(1, heads.count() * 9 // BUCKET)
    hot = int(scaled(np.array([BLOCK]))[0])
    packed, loose = posted(named(docs, heads), scale, hot, buckets, False)
    long = few(loose.groupBy("word").count().where(F.col("count") > BLOCK))
    which = F.struct("far", "doc2", "place2")
    near = candidates(packed, loose, long).groupBy("doc", "place").agg(F.min(which).alias("c"), (F.bool_or("more") | (F.min(which) < F.max(which))).alias("more"))
    pairs = stored(near.select("doc", "place", "c.doc2", "c.place2", "more"), "line-pairs")
    hit = verified(pairs.drop("more"), docs)
    left = stored(pairs.where("more").select("doc", "place").join(hit, ["doc", "place"], "left_anti"), "lines-left")
    if not left.isEmpty():
        probes, asked = posted(named(docs, left), scale, hot, buckets, True)
        some = loose.join(few(asked.select("word").distinct()), "word", "left_semi")
        every = candidates(packed.unionByName(probes), some, long, left).select("doc", "place", "doc2", "place2").distinct()
        rest = stored(every.join(pairs, ["doc", "place", "doc2", "place2"], "left_anti"), "line-pairs")
        discard(packed, probes)
        hit = hit.union(verified(rest, docs))
    return heads.join(hit, ["doc", "place"], "left_anti")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with its texts rid of later matches, and ``n_lines``, ``n_removed``: a struct ``row`` of the columns beside the two."""
    small_batches(docs.sparkSession)
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("doc_id"))
    numbered = whole.where("doc_id is not null")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col("row")[text].cast("binary"), F.lit(b""))
    version = F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.xxhash64(body))) - 1
    held = bucketed(numbered.repartition(n, "doc_id").withColumn("version", version.cast("int")), "doc_id", n, dealt=True)
    slim = held.select("doc_id", "version", body.alias("t"))
    keep = by_doc(first_lines(slim)).hint("shuffle_hash")
    joined = held.join(keep, "doc_id", "left").select("row", "version", "places")
    alone = whole.where("doc_id is null").select("row", F.lit(None).cast("int").alias("version"), F.lit(None).cast("array<bigint>").alias("places"))
    made = joined.unionByName(alone)
    schema = T.StructType([made.schema["row"], *T.StructType.fromDDL("n_lines bigint, n_removed bigint").fields])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).flatten()
            out, total, gone = [], [], []
            for t, v, some in zip(cells[at].to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = (t or "").split("\n")
                mine = [i for i, x in enumerate(rows) if x.strip(BLANK)]
                stay = set(mine) if v is None else {p & 0xFFFFFFFF for p in some or () if p >> 32 == v}
                drop = {i for i in mine if i not in stay}
                out.append("\n".join(x for i, x in enumerate(rows) if i not in drop) if drop else t)
                total.append(len(mine))
                gone.append(len(drop))
            cells[at] = pa.array(out, cells[at].type)
            row = pa.StructArray.from_arrays(cells, fields=list(batch.column(0).type))
            yield pa.RecordBatch.from_arrays([row, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return made.mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; ``n_chars``, where there is one, follows the text."""
    out = deduplicated(docs).select("row.*").select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
