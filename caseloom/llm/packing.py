"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Texts become token ids; an end id closes each document.  Ids beyond a full
sequence are cut off into full pieces, so at most one piece of a document is
shorter than a sequence.  The pieces (numbers only, no ids) are dealt at random
into groups of about ``group_pieces``, and each group is packed on its own.

Defined cases.  A null or empty text is the end id alone.  Repeated documents
are each packed.  An empty table gives no pieces.  A piece is named by its
document and its start, so no text is needed after tokenising.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import map_rows, stored, table

LENGTH = 2048
END = 1
GROUP_PIECES = 20_000
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Encoder:
    """Ids of the byte-level vocabulary in ``path``; loaded once in each Python worker.

    The fast encoder and the vocabulary's own library give equal ids for plain
    text; texts that hold the string of a special token, and any that the fast
    one refuses, go to the library itself.
    """

    held: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # bytes that print stand for themselves, the others for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(map(chr, plain), plain, strict=True)) | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        ranks = {bytes(shown[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def slow(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        if self.exact is None:
            self.exact = Tokenizer.from_file(self.path)
        return self.exact.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if any(x in text for x in self.special):
            return self.slow(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # noqa: BLE001  the fast encoder panics on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slow(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: document, start, length, CRC-32 of its ids, ids of the document."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        enc = Encoder.of(vocabulary)
        rows: list[tuple] = []
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.asarray([*enc.ids(t or ""), end], "<u4")
            for a in range(0, len(ids), length):
                cut = ids[a : a + length]
                rows.append((d, a, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
        yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows) if rows else [[]] * 5, strict=True))

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), PIECES, run)


def first_fit_decreasing(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece.

    A tournament tree holds in each node the largest free room below it, so the
    first bin with room is found from the root in logarithmic time.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [size] * (2 * leaves)
    bins, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offset[i] = node - leaves, size - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offset


def packed(parts: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 10) -> DataFrame:
    """``parts`` with sequence_id and offset; ``parts`` should be a stored table, as it is counted first."""
    groups = max(1, -(-parts.count() // group_pieces))
    dealt = parts.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start"), F.lit(groups)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offset = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=(pdf["__group"].to_numpy() << 32) + bins, offset=offset)

    return dealt.groupBy("__group").applyInPandas(pack, f"{PIECES}, __group bigint, sequence_id bigint, offset bigint").drop("__group")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(stored(pieces(table(spark, sf_dir, "documents")), "pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places."""
    return packed(stored(pieces(docs), "pieces"))
