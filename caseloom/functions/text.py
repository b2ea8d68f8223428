"""Text expressions: cleaning, redaction, identity, summaries, numbers, splits.

All are Columns over built-in functions, but for the positions of spaces,
which an Arrow function counts.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REDACTED = "[개인정보 제외]"
# The three patterns of personal data.
RESIDENT = r"(?U)\b\d{6}[- ]?[1-4]\d{6}\b"
PHONE = r"(?U)\d{2,3}[- ]?\d{3,4}[- ]?\d{4}"
EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
# Particles and words that a query does without.
PARTICLES = "에서는|으로는|에서|에게|으로|하고|이나|까지|부터|해주세요|합니다|인데|입니다|을|를|은|는|이|가"
STOP_WORDS = ["민원", "문의", "요청", "어떻게", "있습니다", "해주세요"]
NUMBER = r"\d+(?:[.,]\d+)*"


def clean(text: Column) -> Column:
    """White space of any kind collapsed to one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(clean(text), 256)


def redact(text: Column) -> Column:
    """Resident numbers first, as the phone pattern would eat their head."""
    out = clean(text)
    for p in (RESIDENT, PHONE, EMAIL):
        out = F.regexp_replace(out, p, REDACTED)
    return out


def mask_inside(text: Column, pattern: str, symbol: str = "*") -> Column:
    """Letters and digits masked inside matches only: pieces and matches are zipped again."""
    pieces = F.split(text, pattern, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, "[0-9A-Za-z]", symbol))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda z: F.array(z["p"], F.coalesce(z["m"], F.lit(""))))), "")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _space_places(texts: pd.Series) -> pd.Series:
    def places(text: str) -> np.ndarray:
        return np.cumsum([len(w) for w in text.split()[:-1]], dtype=np.int32)

    return texts.fillna("").map(places)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _wrap_places(texts: pd.Series) -> pd.Series:
    def places(text: str) -> np.ndarray:
        out, at = [], 0
        for m in re.finditer(r"\S+|\s+", text.strip()):
            if m[0].isspace():
                if re.fullmatch(r"[ \t]*\r?\n[ \t]*", m[0]):
                    out.append(at)
            else:
                at += len(m[0])
        return np.array(out, np.int32)

    return texts.fillna("").map(places)


def identity(text: Column, pdf_wraps: Column | None = None) -> Column:
    """raw and compact hash, length without spaces, places of spaces and of line wraps from a PDF."""
    wraps = F.array().cast("array<int>") if pdf_wraps is None else F.when(pdf_wraps, _wrap_places(text)).otherwise(F.array().cast("array<int>"))
    return F.struct(F.lit(1).alias("v"), fingerprint(text).alias("raw"), F.sha2(compact(text), 256).alias("compact"), F.length(compact(text)).alias("length"), _space_places(text).alias("spaces"), wraps.alias("wraps"))


def equivalent(a: Column, b: Column) -> Column:
    """The same text but for blanks, or differing only in blanks where either side wraps a line."""
    differing = F.array_union(F.array_except(a["spaces"], b["spaces"]), F.array_except(b["spaces"], a["spaces"]))
    wraps = F.array_union(a["wraps"], b["wraps"])
    loose = (a["compact"] == b["compact"]) & (a["length"] == b["length"]) & (F.size(F.array_except(differing, wraps)) == 0)
    return (a["v"] == 1) & (b["v"] == 1) & ((a["raw"] == b["raw"]) | loose)


def normal_header(header: Column) -> Column:
    return F.lower(F.regexp_replace(header, r"(?U)[\s_·-]+", ""))


def first_header(headers: Column, words: list[str]) -> Column:
    """The first header that holds any of the words, once both are normalised; null if none."""
    needles = [re.sub(r"[\s_·-]+", "", w).lower() for w in words]
    return F.get(F.filter(headers, lambda h: F.array_max(F.array(*[F.contains(normal_header(h), F.lit(w)) for w in needles]))), 0)


def signature(headers: Column) -> Column:
    return F.sha2(F.array_join(F.transform(headers, lambda h: F.lower(F.regexp_replace(h, r"(?U)\s+", ""))), "\x1f"), 256)


def sentences(text: Column, most: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"[^.!?。]+[.!?。]?"), F.lit(0)), 1, most)


def summary(text: Column) -> Column:
    """The first three sentences, cleaned, at most 700 characters."""
    return F.left(clean(F.array_join(sentences(text), " ")), F.lit(700))


def quality(text: Column, markers: list[str] = ()) -> Column:
    """Share of readable characters, length and expected markers, at most 1; not rounded."""
    c = compact(text)
    readable = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}.,!?·()\[\]'\"\-:/]", ""))
    found = sum([F.contains(text, F.lit(m)).cast("int") for m in markers], F.lit(0)) / max(len(markers), 1)
    score = F.least(F.length(c) / 160, F.lit(1.0)) * 0.45 + readable / F.length(c) * 0.35 + 0.20 * found
    return F.when(F.length(c) > 0, F.least(score, F.lit(1.0))).otherwise(0.0)


def query_terms(text: Column, most: int = 20) -> Column:
    words = F.regexp_extract_all(text, F.lit("[가-힣A-Za-z0-9]{2,}"), F.lit(0))
    bare = F.transform(words, lambda w: F.regexp_replace(w, f"({PARTICLES})$", ""))
    kept = F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def questions(title: Column, content: Column) -> Column:
    """Two or three parts of ten characters or more are asked one by one."""
    parts = F.filter(F.transform(F.split(content, "[?？]+"), lambda p: clean_ends(p)), lambda p: F.length(p) >= 10)
    each = F.transform(parts, lambda p: F.concat(title, F.lit("\n"), p))
    return F.when(F.size(parts).between(2, 3), each).otherwise(F.array(F.concat(title, F.lit("\n"), content)))


def clean_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def date_in(text: Column) -> Column:
    """The first year-month-day in free text, if the calendar has it."""
    p = r"(\d{4})\D{1,3}(\d{1,2})\D{1,3}(\d{1,2})"
    part = lambda i, n: F.lpad(F.regexp_extract(text, p, i), n, "0")
    return F.when(text.rlike(p), F.try_to_date(F.concat_ws("-", part(1, 4), part(2, 2), part(3, 2)), "yyyy-MM-dd"))


def ids_in(text: Column, patterns: list[str]) -> Column:
    """Distinct positive numbers that any of the patterns captures, in order of the patterns."""
    every = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    return F.filter(F.array_distinct(F.transform(every, lambda x: x.try_cast("long"))), lambda x: x > 0)


def normal_number(token: Column) -> Column:
    """Without thousands commas and leading zeros."""
    bare = F.regexp_replace(token, ",", "")
    whole = F.regexp_replace(F.split(bare, r"\.")[0], "^0+(?=.)", "")
    return F.when(F.contains(bare, F.lit(".")), F.concat(whole, F.lit("."), F.regexp_replace(bare, r"^[^.]*\.", ""))).otherwise(whole)


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), normal_number)


def numbers_missing(summary_text: Column, source: Column) -> Column:
    """Numbers of the summary that the source lacks, repeats kept."""
    have = numbers_in(source)
    return F.filter(numbers_in(summary_text), lambda x: ~F.array_contains(have, x))


def bucket(group: Column, modulus: int = 10_000) -> Column:
    """SHA-1 of a text modulo a number, folded digit by digit as it exceeds 64 bits."""
    digits = F.split(F.sha1(group), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: F.when(x == "", a).otherwise((a * 16 + F.conv(x, 16, 10).cast("long")) % modulus))


def split_of(group: Column, given: Column | None = None) -> Column:
    """train, val or test at 70, 15 and 15 of a hundred; a given split stands."""
    b = bucket(group)
    drawn = F.when(b < 7000, "train").when(b < 8500, "val").otherwise("test")
    return drawn if given is None else F.when(given.isin("train", "val", "test"), given).otherwise(drawn)


def truncated(text: Column, most: int = 1500, mark: str = "…") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))
