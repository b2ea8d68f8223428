"""SimHash near-duplicates through a byte-position inverted index.

Two 64-bit fingerprints that differ in at most three bits differ in at most
three of their eight bytes, so at least five positional bytes are shared.  The
index holds every fingerprint under sets of four byte positions, chosen so
that any three positions miss one set entirely.  So pairs that meet share four bytes
by their key; the other positions are tallied, pairs below the guaranteed five
are dropped, and the rest are verified bit by bit.  Lists of single bytes would
each hold a 256th of all fingerprints, and their pairs grow with the square.

A posting list of any length is compared in blocks of ``BLOCK`` fingerprints,
block against block, in tasks of their own, and each comparison returns a
spanning forest of its links, never all pairs.  Equal fingerprints are one
entry of the index.

Defined cases.  A null or empty text has no words and the fingerprint zero,
which links like any other.  Ties in the least id can't be told apart and need not be.
Very long texts are shingled as a whole.  Only the two named columns are read,
so others may have any names.  Fewer than three words are one shingle.  Repeated
shingles count each time.  Repeated rows fall into one component.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import LOWER, components, map_rows, salted_left, stored, table

SHINGLE, SEED, BITS = 3, 42, 3
BLOCK = 1024
#: Of the 4-sets of positions 0 to 7, those whose numbers cancel under XOR: every three positions lie in exactly one.
FOURS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: The complement of each set, as a bit mask: what is left equal when the differing bytes lie in the set.
MASKS = [signed(sum(0xFF << (8 * i) for i in range(8) if i not in s)) for s in FOURS]


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column(0), "fp": [fingerprint(t or b"") for t in batch.column(1).to_pylist()]}

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t")), "doc_id bigint, fp bigint", run)


def close(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """Where the tally of shared positional bytes reaches the guaranteed five; only of those the bits are compared."""
    diff = x ^ y
    near = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - BITS
    near[near] = np.bitwise_count(diff[near]) <= BITS
    return near


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever of ``fps`` is connected; each fingerprint is reached once."""
    links, rest = [], fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = close(rest, x)
            if near.any():
                found = rest[near]
                links += [(x, y) for y in found]
                front += list(found)
                rest = rest[~near]
    return links


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows with equal ``i, key, lo, hi``; the rows come sorted."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[np.ndarray] | None = None

    def links(cols: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
        fps = cols[4].view(np.uint64)
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        near = close(fps[two], fps[two + 1]) if len(two) else np.zeros(0, bool)
        u, v = [fps[two][near]], [fps[two + 1][near]]
        for a, b in zip(edges[:-1][size > 2], edges[1:][size > 2], strict=True):
            if found := forest(fps[a:b]):
                x, y = zip(*found)
                u.append(np.array(x, np.uint64))
                v.append(np.array(y, np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (u, v)], schema=schema)

    def bounds(cols: list[np.ndarray]) -> np.ndarray:
        change = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:4]:
            change |= c[1:] != c[:-1]
        return np.concatenate(([0], np.flatnonzero(change) + 1, [len(cols[0])]))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        edges = bounds(cols)
        last = edges[-2]
        if last:
            yield links([c[:last] for c in cols], edges[:-1])
        held = [c[last:] for c in cols]
    if held is not None:
        yield links(held, np.array([0, len(held[0])]))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``u, v``: links that connect the distinct fingerprints ``fp`` at ``BITS`` differing bits or fewer."""
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(MASKS)])
    index = fps.select("fp", F.explode(keys).alias("k")).select("k.i", "k.key", "fp")
    sizes = index.groupBy("i", "key").count().where("count > 1")
    posted = index.join(sizes, ["i", "key"]).withColumn("n", F.ceil(F.col("count") / block).cast("int"))
    posted = posted.withColumn("b", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = posted.select("i", "key", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi"), "fp")
    return dealt.repartition("i", "key", "lo", "hi").sortWithinPartitions("i", "key", "lo", "hi").mapInArrow(compared, "u bigint, v bigint")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    marked = stored(fingerprints(docs, doc_id, text), "fingerprints")
    first = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")), "distinct-fingerprints")
    roots = components(links(first.select("fp")))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "n_rows")
    return salted_left(marked, named, "fp", "doc_id", "n_rows")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the smallest id; of repeated rows of it, one for each of its texts.

    Documents without an id can't be told apart by it and are all kept.
    """
    heads = classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))
