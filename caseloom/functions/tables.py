"""Table functions for SQL: the clauses and the chunks of a text, by lateral join.

    SELECT d.doc_id, c.* FROM laws d, LATERAL clauses_of(d.text) c
    SELECT d.doc_id, c.* FROM laws d, LATERAL chunks_of(d.text, 400, 'words') c

``register`` makes them known to a session.  Arguments are checked when the
query is analysed; a null text has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from caseloom.functions import clauses as fc

#: Tokenizers by the name that SQL gives: places of a text's tokens.
TOKENIZERS: dict[str, Callable[[str], list[tuple[int, int]]]] = {
    "words": fc.word_spans,
    "characters": lambda text: [(i, i + 1) for i in range(len(text))],
    "pieces": lambda text: [m.span() for m in re.finditer(r"\w+|[^\w\s]", text)],
}

string, integer = T.StringType(), T.IntegerType()
CLAUSE = T.StructType([
    T.StructField("number", integer), T.StructField("key", string), T.StructField("heading", string), T.StructField("start", integer), T.StructField("end", integer),
    T.StructField("internal", T.ArrayType(string)), T.StructField("external", T.ArrayType(T.StructType([T.StructField("law", string), T.StructField("key", string)]))), T.StructField("exception", T.BooleanType()),
])
CHUNK = T.StructType([T.StructField("chunk", integer), T.StructField("start", integer), T.StructField("end", integer), T.StructField("tokens", integer), T.StructField("content", string)])


def is_text(argument: AnalyzeArgument, name: str) -> None:
    if argument.isTable or not isinstance(argument.dataType, (T.StringType, T.NullType)):
        raise ValueError(f"{name} takes a text first, not {argument.dataType}")


class ClausesOf:
    """The clauses of a text: number, key, heading, span, cited keys, and whether they state an exception."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        is_text(text, "clauses_of")
        return AnalyzeResult(CLAUSE)

    def eval(self, text: str | None) -> Iterator[tuple]:
        for u in fc.clauses(text or "") if text is not None else ():
            yield tuple(u[f] for f in CLAUSE.names)


class ChunksOf:
    """Spans that cover a text, of at most ``target`` tokens of the named tokenizer where that can be."""

    @staticmethod
    def analyze(text: AnalyzeArgument, target: AnalyzeArgument, tokenizer: AnalyzeArgument) -> AnalyzeResult:
        is_text(text, "chunks_of")
        if not target.isConstantExpression or not isinstance(target.value, int) or target.value < 1:
            raise ValueError("chunks_of takes a constant number of tokens, at least 1")
        if not tokenizer.isConstantExpression or tokenizer.value not in TOKENIZERS:
            raise ValueError(f"chunks_of knows the tokenizers {', '.join(TOKENIZERS)}")
        return AnalyzeResult(CHUNK)

    def eval(self, text: str | None, target: int, tokenizer: str) -> Iterator[tuple]:
        for i, (a, b, n) in enumerate(fc.spans(text, target, TOKENIZERS[tokenizer]) if text else ()):
            yield i, int(a), int(b), int(n), text[a:b]


def register(spark: SparkSession) -> None:
    spark.udtf.register("clauses_of", udtf(ClausesOf))
    spark.udtf.register("chunks_of", udtf(ChunksOf))
