"""Host-level quality rules.

Every document is measured; rule failures are counted by host; host rates are
shrunk with a beta prior that is fitted to all hosts, and judged against it;
the verdict of a host goes back to its documents.

Defined cases.  A null or empty text has no words, so the base rules fail it.
A null host is a host of its own.  Repeated rows count as often as they occur.
An empty table gives an empty result.  Columns of the input keep their names
and are carried through; measures of the same names are not confused with
them, because measures are held in one struct until the end.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import SPACES, add_columns, salted_left, stored, table

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: How many times likelier each failed soft rule makes it that a document is junk.
EVIDENCE = 8.0
#: The most documents that the prior can weigh as much as, where hosts do not differ beyond chance.
HEAVIEST = 1e6


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = list(map(hash, zip(*(words[i:] for i in range(width)))))
    if len(set(hashes)) == n:
        return 0
    often = {h for h, k in Counter(hashes).items() if k > 1}
    starts = [i for i, h in enumerate(hashes) if h in often]
    exact = Counter(tuple(words[i : i + width]) for i in starts)
    covered, end = 0, 0
    for i in starts:
        if exact[tuple(words[i : i + width])] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    chars = len(text.decode()) - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_measures(docs: DataFrame, text: str = "text", into: str = "__m") -> DataFrame:
    """``docs`` with a struct ``into`` of the measures of each whole text."""

    def run(texts: list[bytes]) -> list[list]:
        names = [x.split()[0] for x in MEASURES.split(", ")]
        return [[dict(zip(names, measure(x), strict=True)) for x in texts]]

    return add_columns(docs, text, f"{into} struct<{', '.join(x.replace(' ', ': ') for x in MEASURES.split(', '))}>", run)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def soft_failures(m: Column) -> Column:
    """How many rules are failed that reject a document only together with its host's verdict."""
    rules = (10 * m["n_symbols"] > m["n_words"], 10 * m["n_dup_lines"] > 3 * m["n_lines"], (m["word_chars"] > 15 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"]))
    return sum((r.cast("int") for r in rules), F.lit(0))


def host_verdicts(measured: DataFrame, host: str = "source", m: str = "__m") -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate, and how many soft rules its documents may fail.

    The prior beta(a, b) has the mean of all documents and the variance of the
    hosts' rates less what chance alone gives hosts of their sizes.  The shrunk
    rate gives the odds that a document of the host is junk; a document goes if
    its failed rules, each worth ``EVIDENCE``, turn these odds to one or more.
    """
    by_host = measured.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host"), F.col(host).isNull().alias("__no_host")).agg(
        F.count("*").alias("n_docs"), F.count_if(base_failed(F.col(m)) | (soft_failures(F.col(m)) > 0)).alias("n_failed")
    )
    by_host = stored(by_host, "hosts")
    row = by_host.agg(F.sum("n_docs"), F.sum("n_failed"), F.var_samp(F.col("n_failed") / F.col("n_docs")), F.avg(1 / F.col("n_docs"))).first()
    docs, failed, spread, inverse = (float(x) if x is not None else 0.0 for x in row)
    mean, weight = prior(docs, failed, spread, inverse)
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    allowed = F.when(rate > 0, F.greatest(F.lit(0.0), F.ceil(F.log((1 - rate) / rate) / F.lit(math.log(EVIDENCE)) - 1e-9) - 1)).otherwise(3.0)
    return by_host.withColumn("rate", rate).withColumn("allowed", allowed.cast("int"))


def prior(docs: float, failed: float, spread: float, inverse: float) -> tuple[float, float]:
    """Mean and weight (a + b) of the prior, from sums over hosts, the variance of their rates and the mean of one over their sizes."""
    mean = failed / docs if docs else 0.0
    chance = mean * (1 - mean)
    between = spread - chance * inverse
    return mean, min(max(chance / between - 1, 1.0), HEAVIEST) if between > 0 else HEAVIEST


def judged(measured: DataFrame, host: str = "source", by: str = "doc_id", m: str = "__m") -> DataFrame:
    """``measured`` with ``__kept``; ``by`` spreads a hot host's rows."""
    verdict = host_verdicts(measured, host, m).select(F.concat(F.col("__no_host").cast("string"), "__host").alias("__key"), "allowed", "n_docs")
    keyed = measured.withColumn("__key", F.concat(F.col(host).isNull().cast("string"), F.coalesce(F.col(host).cast("string"), F.lit(""))))
    kept = ~base_failed(F.col(m)) & (soft_failures(F.col(m)) <= F.col("allowed"))
    return salted_left(keyed, verdict, "__key", by, "n_docs").withColumn("__kept", kept).drop("__key", "allowed")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = stored(with_measures(docs).select("doc_id", "source", "__m"), "measures")
    m = F.col("__m")
    return judged(measured).select(
        "doc_id", *[m[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed(m).alias("base_failed"), F.col("__kept").alias("kept")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the columns they came with; texts are measured once and travel in one struct with the rest."""
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text", F.col("source").alias("host"), F.col("doc_id").alias("by"))
    measured = stored(with_measures(row).drop("text"), "measured-documents")
    return judged(measured, "host", "by").where("__kept").select("row.*")
