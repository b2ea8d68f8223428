"""Queries on calls of embedders and models, with deterministic stubs in their place."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text
from caseloom.operators import models, rules
from caseloom.plans.registry import Tables, query
from caseloom.plans.texts import CATALOGUE, REDACT, RULES, SPECIFIC
from caseloom.sources.scratch import folder

C = F.col
LETTERS = "aeinorst"
#: Characters that the stub embedder takes.
ROOM = 12_000


def embedder(texts: list[str]) -> list[list[float]]:
    """Counts of eight letters; refuses long texts, and gives one component too few now and then."""
    for t in texts:
        if len(t) > ROOM:
            raise models.RowError(f"{len(t)} characters are over the limit")
    return [[float(t.count(c)) for c in LETTERS][: 7 if len(t) % 11 == 0 else 8] for t in texts]


COUNTED = ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE) AS {c}" for c in LETTERS)
SQUARE = " + ".join(f"{c} * {c}" for c in LETTERS)
ZERO = " + ".join(LETTERS)


@query(
    f"WITH c AS (SELECT doc_id, length(text) AS size_of, regexp_full_match(text, '\\s*') AS blank, {COUNTED} FROM documents), "
    f"w AS (SELECT *, CASE WHEN blank THEN NULL WHEN size_of > {ROOM} THEN size_of || ' characters are over the limit' WHEN size_of % 11 = 0 THEN 'dimension 7 instead of 8' WHEN {ZERO} = 0 THEN 'all components are zero' END AS warning, sqrt({SQUARE}) AS size FROM c) "
    "SELECT doc_id, warning, CASE WHEN NOT blank AND warning IS NULL THEN round(a / size, 6) END AS a, CASE WHEN NOT blank AND warning IS NULL THEN round(e / size, 6) END AS e, CASE WHEN NOT blank AND warning IS NULL THEN round(t / size, 6) END AS t FROM w"
)
def embedded_documents(t: Tables) -> DataFrame:
    """A vector for every document, or the reason why it has none."""
    d = models.embed(t.documents.select("doc_id", "text"), "text", embedder, len(LETTERS), "v", "warning")
    return d.select("doc_id", "warning", *(F.round(C("v")[LETTERS.index(c)], 6).alias(c) for c in "aet"))


CLASSES = ["alpha", "beta", "gamma"]


def model(texts: list[str]) -> list[str]:
    """An answer that follows from the content's digest: some refused, some without JSON, of an unknown class, or without a summary."""
    out = []
    for t in texts:
        d = hashlib.md5(t.encode()).hexdigest()[0]
        if d in "01":
            raise models.RowError("refused")
        said = {"category": "delta" if d == "4" else CLASSES[ord(d) % 3], "summary": " " if d == "6" else f"about {len(t)} characters", "urgency": "high" if d in "ab" else "none"}
        out.append("no JSON here" if d in "23" else f"```json\n{json.dumps(said)}\n```" if d == "5" else f"Here it is: {json.dumps(said)} - done" if d == "7" else json.dumps(said))
    return out


@query(
    RULES
    + f", d AS (SELECT doc_id, CASE WHEN l[1] > 0 THEN names[1] ELSE 'other' END AS category, l[1] AS top, l[1] > 0 AND (l[1] < 3 OR l[1] - l[2] < 2) AS needs, redacted FROM b JOIN (SELECT doc_id, {REDACT} AS redacted FROM documents) USING (doc_id)), "
    "o AS (SELECT *, left(md5(redacted), 1) AS h, CASE WHEN NOT CASE WHEN trim(redacted) = '' THEN false WHEN needs THEN true WHEN length(redacted) < 20 THEN false ELSE top = 0 AND length(redacted) < 80 END THEN 'skipped' WHEN left(md5(redacted), 1) IN ('0', '1') THEN 'failed' ELSE 'ok' END AS outcome FROM d), "
    "u AS (SELECT *, outcome = 'ok' AND h NOT IN ('2', '3', '4', '6') AS used FROM o) "
    "SELECT doc_id, outcome, CASE WHEN used THEN ['alpha', 'beta', 'gamma'][CAST(ord(h) % 3 + 1 AS BIGINT)] ELSE category END AS category, CASE WHEN used THEN 'about ' || length(redacted) || ' characters' END AS summary, CASE WHEN used AND h IN ('a', 'b') THEN 'high' ELSE 'medium' END AS urgency, "
    "CASE WHEN used THEN 'model' WHEN outcome = 'failed' THEN 'rule after failure' WHEN outcome = 'ok' THEN 'rule after an invalid answer' ELSE 'rule' END AS evidence FROM u"
)
def model_decisions(t: Tables) -> DataFrame:
    """Only documents that the rules leave open are sent; answers are checked, and the rule stands where there is none."""
    low = t.documents.select("doc_id", "text", F.lower("text").alias("low"))
    ruled = rules.classified(low, "low", CATALOGUE, SPECIFIC, {}, {}, "other", None).select("doc_id", "rule", text.redact(C("text")).alias("redacted"))
    told = models.apply_model(ruled, "redacted", rules.wants_model(C("rule"), C("redacted"), other="other"), model, folder(t.spark, "answers"))
    return told.select("doc_id", "outcome", models.decided(C("rule"), C("answer"), C("outcome"), CLASSES).alias("d")).select("doc_id", "outcome", "d.*")
