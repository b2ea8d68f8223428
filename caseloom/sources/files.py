"""Delimited, line and JSON files that people hand in: read what can be read, set the rest aside."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_LIMIT = 2_000_000
REASON_LIMIT = 2000
#: Quotes are doubled, and nothing else is special beside them; by default the parser drops a zero character there.
QUOTED = {"header": True, "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"'}


def read_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8", sep: str = ",", null: str = "") -> DataFrame:
    """Every record as strings: quoted line breaks and doubled quotes kept, blank lines skipped.

    A record of another width keeps its raw text in ``_corrupt``; short ones are
    padded with nulls.  Values equal to ``null`` are nulls.
    """
    schema = T.StructType([*[T.StructField(c.strip(), T.StringType()) for c in columns], T.StructField("_corrupt", T.StringType())])
    options = {"multiLine": True, "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "maxCharsPerColumn": -1, "encoding": encoding, "enforceSchema": True, "nullValue": null}
    return spark.read.schema(schema).options(**QUOTED, **options).csv(path)


def write_csv(rows: DataFrame, path: str, null: str = "", by: Sequence[str] = ()) -> None:
    """All values in quotes and as they are, blanks at their ends included; ``null`` stands for nulls."""
    rows.write.partitionBy(*by).options(**QUOTED, quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue=null).csv(path)


def surplus(rows: DataFrame, columns: list[str], sep: str = ",") -> DataFrame:
    """``rows`` with ``extra``: all values beyond the columns, from the raw text of records that are too wide; empty ones are left out."""
    n = len(columns)

    @F.pandas_udf("array<string>")
    def beyond(raw: pd.Series) -> pd.Series:
        csv.field_size_limit(1 << 31)
        return raw.map(lambda x: [] if x is None else [v for v in next(csv.reader(io.StringIO(x, newline=""), delimiter=sep), [])[n:] if v])

    return rows.withColumn("extra", beyond("_corrupt"))


def oversize(columns: list[str], limit: int = FIELD_LIMIT) -> Column:
    """Whether any field is longer than the limit; several count once."""
    return F.greatest(*[F.coalesce(F.length(c), F.lit(0)) for c in columns], F.lit(0)) > limit


def split_quarantine(rows: DataFrame, bad: Column, kind: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and of the bad ones only their key and what was wrong."""
    flag = F.coalesce(bad, F.lit(False))
    return rows.where(~flag), rows.where(flag).select(key, F.lit(kind).alias("kind"))


def sniffed(files: DataFrame) -> DataFrame:
    """``path, encoding`` of binary files: a byte-order mark, else strict UTF-8 of the first 64 KiB, else cp949."""
    head = F.substring("content", 1, 65536)
    # up to three bytes of a character that the cut has split do not count
    valid = F.lit(False)
    for cut in range(4):
        valid = valid | F.is_valid_utf8(F.when(F.octet_length(head) < 65536, head).otherwise(F.substring("content", 1, 65536 - cut)).cast("string"))
    mark = F.hex(F.substring("content", 1, 3))
    known = F.when(mark.startswith("EFBBBF"), "utf-8-sig").when(mark.startswith("FFFE"), "utf-16-le").when(mark.startswith("FEFF"), "utf-16-be")
    return files.select("path", F.coalesce(known, F.when(valid, "utf-8").otherwise("cp949")).alias("encoding"))


def preview(rows: DataFrame, columns: list[str], size: int = 5, chars: int = 500) -> DataFrame:
    return rows.limit(size).select(*[F.left(F.trim(c), F.lit(chars)).alias(c) for c in columns])


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` of text files, lines numbered from 1 in each file.

    A split's lines are read in order, so a line's number is its place in the split
    and the lines of the file's earlier splits.  Only a count for each split is
    gathered; the lines themselves don't move.
    """
    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), place.alias("place"), "value")
    splits = lines.groupBy("file", "at").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("at")) - F.col("n")
    return lines.join(splits.select("file", "at", "first", before.alias("before")), ["file", "at"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Objects, and an error row for each line that is none; both keep file and line."""
    lines = numbered(spark, path).where(F.length(F.trim("value")) > 0)
    is_object = F.coalesce(F.json_object_keys("value").isNotNull(), F.lit(False))
    good = lines.where(is_object).select("file", "line", F.from_json("value", schema).alias("r")).select("file", "line", "r.*")
    valid = F.try_parse_json("value").isNotNull()
    return good, lines.where(~is_object).select("file", "line", F.when(valid, "not an object").otherwise("not JSON").alias("error"), F.left("value", F.lit(200)).alias("head"))


def failures(rows: DataFrame, key: str, reason: Column) -> DataFrame:
    """Key, the raw row as JSON, and a reason cut at its limit."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("raw"), F.left(reason, F.lit(REASON_LIMIT)).alias("reason"))


def headers_located(cells: DataFrame, title_words: list[str], body_words: list[str], leading: int = 30) -> DataFrame:
    """Records of sheets (file, sheet, row, cells): the first leading row with a title and a body header names the rest."""
    plain = F.transform("cells", lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")))
    has = lambda words: F.exists(plain, lambda c: c.isin(words))
    heads = cells.where((F.col("row") <= leading) & has(title_words) & has(body_words)).groupBy("file", "sheet").agg(F.min(F.struct("row", "cells")).alias("h"))
    below = cells.join(heads, ["file", "sheet"]).where(F.col("row") > F.col("h.row"))
    names = F.array_distinct(F.filter("h.cells", lambda c: c.isNotNull() & (c != "")))
    record = F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.get("cells", F.array_position("h.cells", k).cast("int") - 1))))
    return below.select("file", "sheet", "row", record.alias("record"))


# The marks of a case page.
CASE, CAUSE, STOP = r"사례\s*(\d{3,})\b", r"신청원인\s*", r"피신청인\s*등의\s*주장|가상\s*민원\s*데이터"


def case_pages(pages: DataFrame, case: str = CASE, cause: str = CAUSE, stop: str = STOP) -> DataFrame:
    """Cases of pages (file, page, text): number, title lines before the cause, body up to a stop; else one record a file."""
    parts = F.split("text", cause, 2)
    lines = F.filter(F.transform(F.split(parts[0], "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(case))
    body = F.regexp_replace(F.split(F.get(parts, 1), stop, 2)[0], r"(?U)^\s+|\s+$", "")
    found = pages.where(F.col("text").rlike(case) & (F.size(parts) == 2)).select("file", F.col("page").alias("row"), F.regexp_extract("text", case, 1).alias("number"), F.array_join(lines, " ").alias("title"), body.alias("body")).where("title <> '' and body <> ''")
    rest = pages.join(found.select("file").distinct(), "file", "left_anti").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"]), "\n").alias("body"))
    return found.unionByName(rest.select("file", F.lit(1).alias("row"), F.lit(None).cast("string").alias("number"), F.col("file").alias("title"), "body").where("body <> ''"))


def case_blocks(texts: DataFrame, heading: str, cause: str = CAUSE, stop: str = STOP) -> DataFrame:
    """One long text cut before each heading line; each block read like a case page."""
    blocks = texts.select("file", F.posexplode(F.split("text", f"(?m)(?={heading})")).alias("page", "text"))
    return case_pages(blocks, heading, cause, stop)


def best_candidate(candidates: DataFrame, keys: list[str], score: str, rank: str) -> DataFrame:
    """The best scored text of each page; an alternate wins only if strictly better."""
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(rank))).alias("b")).select(*keys, "b.*")


def new_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose content no stored file has."""
    return files.withColumn("hash", F.sha2("content", 256)).join(manifest.select("hash"), "hash", "left_anti")


def within_size(files: DataFrame, most: int) -> DataFrame:
    """Files of a size that is read at all; ``length`` is metadata, so contents stay unread."""
    return files.where(F.col("length") <= most)
