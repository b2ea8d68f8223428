"""Reading JSON that models and people wrote."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How code fences, tool calls, and thoughts are written.
FENCE = r"^\s*```[A-Za-z]*\s*\n?|\n?\s*```\s*$"
CALL = re.compile(r"<\|tool_call>\s*call:([\w.\-]+)\s*(\{.*?\})\s*<tool_call\|>", re.DOTALL)
THOUGHT = re.compile(r"<\|channel>.*?<channel\|>", re.DOTALL)


def is_object(text: Column) -> Column:
    return F.coalesce(F.get_json_object(text, "$").rlike(r"(?s)^\s*\{") & F.json_object_keys(text).isNotNull(), F.lit(False))


def object_in(text: Column) -> Column:
    """The first reading that is an object: as it is, without a fence, or from the first to the last brace."""
    bare = F.trim(F.regexp_replace(text, FENCE, ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    ways = [text, bare, inner]
    return F.coalesce(*[F.when(is_object(w), w) for w in ways])


def tool_result(text: Column) -> Column:
    """JSON as it is, or with single quotes turned to double ones."""
    other = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false"), r"\bNone\b", "null")
    return F.coalesce(*[F.when(is_object(w), w) for w in (text, other)])


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("tool", "arguments", "text")]))
def tool_call(raw: pd.Series) -> pd.DataFrame:
    """A call with bare keys and guarded strings: its name, its arguments as JSON, and the text around it."""
    def read(text: str | None) -> tuple:
        text = THOUGHT.sub("", text or "")
        m = CALL.search(text)
        rest = CALL.sub("", text).strip()
        if not m:
            return None, None, rest
        # every other part lies inside a pair of guards, where nothing is a key
        parts = m[2].split('<|"|>')
        body = "".join(json.dumps(p, ensure_ascii=False) if i % 2 else re.sub(r"([{,]\s*)([A-Za-z_][\w\-]*)\s*:", r'\1"\2":', p) for i, p in enumerate(parts))
        try:
            value = json.loads(body)
        except ValueError:
            value = None
        return m[1], json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else None, rest

    return pd.DataFrame([read(x) for x in raw], columns=["tool", "arguments", "text"])
