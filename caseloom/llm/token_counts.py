"""Token counts: batch encoding in Arrow functions that return lengths only.

A long text is cut where no token of the vocabulary can reach across.  The
pieces of many texts fill batches of about equal bytes, each batch is parted
further into words with the white space before them, and only words that the
worker hasn't met go to the vocabulary's own library, in calls balanced by
bytes.  A text's length is the sum over its words; ids never leave the call.

Where a cut is safe.  For byte-level ``.json`` vocabularies with their usual
pattern: between anything but white space and white space (the pattern has no
token with white space after another sign), and, in runs longer than a piece,
between ASCII letters and digits and before full-width stops after Han, kana
or Hangul.  For ``.model`` vocabularies without a piece that holds a space
after another sign: at a single space between visible ASCII signs; the space
falls away, as the library puts one before every text.  Other vocabularies are
given whole texts.

Defined cases.  A null or empty text has 0 bytes and 0 tokens.  Strings of
special tokens count as the library counts them by default.  A very long text
is handled piece by piece; a run without any safe cut is one piece.  Equal and
repeated rows each give a row.  A null id is kept.  Columns beside id and text
are not read, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import map_rows, table

LIMIT = 1024
#: Characters of a piece, bytes of a batch of pieces, and bytes that one call of the library gets.
PIECE, BATCH, CALL = 1 << 18, 1 << 20, 1 << 18
#: Words whose lengths a worker remembers; when full it starts anew.  Longer words are not remembered.
KNOWN, LONGEST = 400_000, 48
#: White space that all versions of the pattern's \s share, and signs that some count as white space.
SPACE = " \t\n\r\x0b\x0c"
MAYBE = r"\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
WORDS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BEFORE_SPACE = re.compile(f"(?<=[^{SPACE}{MAYBE}])(?=[{SPACE}])")
IN_RUNS = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[\u4e00-\u9fa5\u3041-\u3096\u30a1-\u30fa\uac00-\ud7a3])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
SINGLE_SPACE = re.compile("(?<=[!-~]) (?=[!-~])")
DOUBTFUL = re.compile(f"[{MAYBE}]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(text: str, patterns: list[re.Pattern], size: int) -> Iterator[str]:
    """Pieces of ``text``, each ending at the first match of a pattern from ``size`` characters on; what matches falls away."""
    low = 0
    while len(text) - low > size:
        found = next((m for p in patterns if (m := p.search(text, low + size, low + 2 * size))), None) or next((m for p in patterns if (m := p.search(text, low + size))), None)
        if found is None:
            break
        yield text[low : found.start()]
        low = found.end()
    yield text[low:]


def by_bytes(items: Iterator[str], size: int) -> Iterator[list[str]]:
    """Lists of consecutive items of about ``size`` bytes; a larger item is alone in its list."""
    now, total = [], 0
    for x in items:
        n = len(x) if x.isascii() else len(x.encode())
        if now and total + n > size:
            yield now
            now, total = [], 0
        now.append(x)
        total += n
    if now:
        yield now


class Lengths:
    """Numbers of tokens by the library of the vocabulary in ``path``; one is held in each Python worker."""

    held: dict[str, "Lengths"] = {}

    def __init__(self, path: str, piece: int = PIECE):
        self.piece, self.known, self.patterns, self.words = piece, {}, [], False
        if path.endswith(".model"):
            import sentencepiece

            lib = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: list(map(len, lib.encode(texts, num_threads=1)))
            inner = re.compile("[^▁]▁")
            spaced = lib.encode("a", out_type=str) == lib.encode(" a", out_type=str)[-1:] or lib.encode("a", out_type=str)[0].startswith("▁")
            if spaced and not any(inner.search(lib.id_to_piece(i)) for i in range(lib.get_piece_size())):
                self.patterns = [SINGLE_SPACE]
        elif path.endswith(".json"):
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many workers as there are cores
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(path)
            lib.no_truncation()
            lib.no_padding()
            self.encode = lambda texts: list(map(len, lib.encode_batch_fast(texts, add_special_tokens=False)))
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
            plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
            if plain and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(f"[{SPACE}{MAYBE}]", x["content"]) or IN_RUNS.search(x["content"]) for x in added):
                self.patterns, self.words = [BEFORE_SPACE, IN_RUNS], True
        else:
            raise ValueError(f"no library reads {path}: .json and .model are known")

    @classmethod
    def of(cls, path: str) -> "Lengths":
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def called(self, items: list[str]) -> list[int]:
        return [n for part in by_bytes(iter(items), CALL) for n in self.encode(part)]

    def of_pieces(self, pieces: list[str]) -> list[int]:
        """The lengths of one batch of pieces."""
        if not self.words:
            return self.called(pieces)
        if len(self.known) > KNOWN:
            self.known.clear()
        # a piece that holds doubtful white space is not parted into words
        parted = [[p] if DOUBTFUL.search(p) else WORDS.findall(p) for p in pieces]
        new = list({w for words in parted for w in words if w not in self.known})
        got = dict(zip(new, self.called(new), strict=True))
        self.known.update((w, n) for w, n in got.items() if len(w) <= LONGEST)
        long = {w: n for w, n in got.items() if len(w) > LONGEST}
        return [sum([self.known[w] if w in self.known else long[w] for w in words]) for words in parted]

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        owner: list[int] = []

        def pieces() -> Iterator[str]:
            for i, t in enumerate(texts):
                for p in cuts(t, self.patterns, self.piece) if self.patterns else [t]:
                    owner.append(i)
                    yield p

        at = 0
        for batch in by_bytes(pieces(), BATCH):
            for n in self.of_pieces(batch):
                out[owner[at]] += n
                at += 1
        return out


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; nothing is shuffled and no id leaves a worker."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = pc.fill_null(batch.column(1), "")
        n = Lengths.of(vocabulary)(texts.to_pylist())
        yield {"doc_id": batch.column(0), "n_bytes": pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_rows(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", run)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))
