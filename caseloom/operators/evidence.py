"""Clauses, chunks, versions, citations and nearest rows, for many questions at once."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.functions import clauses as fc
from caseloom.functions import vectors
from caseloom.sources.scratch import small_batches, stored

CLAUSES = "doc_id bigint, number int, key string, heading string, start int, end int, internal array<string>, external array<struct<law:string,key:string>>, exception boolean"
#: Limits of one walk: clauses, sources, hops to other laws, look-ups of laws.
MOST_CLAUSES, MOST_SOURCES, HOPS, LOOKUPS = 96, 16, 3, 32
#: Characters of a stretch in which clauses and hits meet.
WIDTH = 2048
#: Queries of a block of the vector search, and rows that are scored against them at once.
QUERIES, SLICE = 2000, 1000
DEFINITION, TERM = r"\((?:정의|적용\s*범위|적용\s*제외)\)", r"[\"“]([^\"”]{1,50})[\"”]"


def clause_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per clause of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"doc_id": d, **u} for d, t in zip(pdf["doc_id"], pdf["t"]) for u in fc.clauses(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "number", "key", "heading", "start", "end", "internal", "external", "exception"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col(text).alias("t")).mapInPandas(run, CLAUSES)


def chunk_table(docs: DataFrame, target: int, text: str = "text", tokens: Callable = fc.word_spans) -> DataFrame:
    """Spans that cover each document, with their texts and token counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, a, b, n, t[a:b]) for d, t in zip(pdf["doc_id"], pdf["t"].fillna("")) for i, (a, b, n) in enumerate(fc.spans(t, target, tokens))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "tokens", "content"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col(text).alias("t")).mapInPandas(run, "doc_id bigint, chunk int, start int, end int, tokens int, content string")


def byte_table(docs: DataFrame, most: int, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, p) for d, t in zip(pdf["doc_id"], pdf["t"].fillna("")) for i, p in enumerate(fc.byte_pieces(t, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "content"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col(text).alias("t")).mapInPandas(run, "doc_id bigint, piece int, content string")


def span_proof(chunks: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Whether a document's chunks join without gap, equal their slices, and end where it ends.

    Chunks travel as places and digests, each text once; a text without chunks is proven only if it is empty.
    """
    spans = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.md5("content").alias("digest")))).alias("__spans"))
    joined = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("__t")).join(spans, "doc_id", "left")
    fits = lambda at, s: (s["start"] == at) & (F.md5(F.substring("__t", s["start"] + 1, s["end"] - s["start"])) == s["digest"])
    reached = F.aggregate("__spans", F.lit(0), lambda at, s: F.when(fits(at, s), s["end"]).otherwise(-1))
    return joined.select("doc_id", (F.coalesce(reached, F.lit(0)) == F.length("__t")).alias("proven"), F.coalesce(F.array_size("__spans"), F.lit(0)).cast("long").alias("n_chunks"))


def nearest(found: list, query_id: str, row_id: str, k: int) -> Callable:
    """A function over batches of rows that keeps the ``k`` nearest of each of the ``found`` queries."""
    import numpy as np

    ids = np.array([r[0] for r in found])
    q = np.array([r[1] for r in found])
    q = q / np.linalg.norm(q, axis=1, keepdims=True) if len(q) else q

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in batches:
            for a in range(0, len(pdf) if len(ids) else 0, SLICE):
                part = pdf[a : a + SLICE].sort_values(row_id)
                x = np.array(part["v"].tolist(), float)
                s = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                each = pd.DataFrame({query_id: np.repeat(ids, at.shape[1]), row_id: part[row_id].to_numpy()[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()})
                best = each if best is None else pd.concat([best, each])
                best = best.sort_values(["score", row_id], ascending=[False, True]).groupby(query_id, sort=False).head(k)
        if best is not None:
            yield best

    return run


def top_k(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, vector: str, k: int) -> DataFrame:
    """The ``k`` rows of greatest cosine for each query, exactly, in blocks of at most ``QUERIES`` queries.

    A block goes to every task as one array, so rows are neither shuffled nor
    paired up before they are scored, and each task keeps ``k`` rows a query.
    One block is answered lazily; of several, the driver holds one at a time and
    stores its answers before it fetches the next.
    """
    types = dict(queries.dtypes)[query_id], dict(rows.dtypes)[row_id]
    vectors_of = rows.select(row_id, vectors.doubles(F.col(vector)).alias("v"))

    def near(found: list) -> DataFrame:
        run = nearest(found, query_id, row_id, k)
        return vectors_of.mapInPandas(run, f"{query_id} {types[0]}, {row_id} {types[1]}, score double")

    found = iter(queries.select(query_id, vectors.doubles(F.col(vector)).alias("v")).toLocalIterator())
    block, ahead = list(islice(found, QUERIES)), list(islice(found, 1))
    parts = []
    while ahead:
        parts.append(stored(near(block), "nearest"))
        block, ahead = ahead + list(islice(found, QUERIES - 1)), list(islice(found, 1))
    out = near(block)
    for p in parts:
        out = out.unionByName(p)
    place = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), row_id))
    return out.withColumn("place", place).where(F.col("place") <= k)


def versions(rows: DataFrame, group: Column, key: str, day: Column, version: Column, as_of: Column) -> DataFrame:
    """``rows`` with ``eligible`` and ``warning``: which version of a group holds on a date.

    One row: unless it lies ahead.  Several, one undated: none when their
    versions differ or lack a name, else all that do not lie ahead.  All dated:
    the latest day that has come, if one row alone has it.
    """
    flat = rows.withColumn("__g", group).withColumn("__d", day).withColumn("__v", F.coalesce(version, F.lit("")))
    past = F.col("__d") <= as_of
    latest = F.max(F.when(past, F.col("__d")))
    facts = flat.groupBy("__g").agg(F.count("*").alias("__n"), F.count("__d").alias("__dated"), F.count_distinct("__v").alias("__names"), F.min("__v").alias("__least"), latest.alias("__latest"))
    ties = flat.where(past).groupBy("__g", "__d").agg(F.count("*").alias("__same"))
    j = flat.join(facts, "__g").join(ties, ["__g", "__d"], "left")
    mixed = F.col("__dated") < F.col("__n")
    vague = mixed & ((F.col("__names") > 1) | (F.col("__least") == ""))
    tie = F.max(F.when(F.col("__d") == F.col("__latest"), F.col("__same"))).over(W.partitionBy("__g"))
    open_or_past = F.col("__d").isNull() | past
    eligible = F.when(F.col("__n") == 1, open_or_past).when(mixed, ~vague & open_or_past).otherwise((F.col("__d") == F.col("__latest")) & (F.col("__same") == 1))
    warning = F.when((F.col("__n") > 1) & vague, "versions cannot be told apart").when((F.col("__n") > 1) & ~mixed & (tie > 1), "two versions of one day")
    return j.withColumn("warning", warning).withColumn("eligible", F.coalesce(eligible, F.lit(False))).drop(*[c for c in j.columns if c.startswith("__")])


def overlapping(clause_rows: DataFrame, hits: DataFrame, width: int = WIDTH) -> DataFrame:
    """Clauses that a span of their document touches, a row for each such span; other columns of ``hits`` come along.

    Spans meet by document and stretch of ``width`` characters, so a long
    document with many hits is many small joins.  A pair belongs to the stretch
    in which the later of the two begins, and is found there alone.
    """
    more = [c for c in hits.columns if c not in ("doc_id", "start", "end")]
    stretch = lambda c: F.floor(c / F.lit(width)).cast("int")
    over = lambda a, b: F.explode(F.sequence(stretch(a), stretch(F.greatest(a, b - 1))))
    h = hits.select("doc_id", F.col("start").alias("__a"), F.col("end").alias("__b"), *more).withColumn("__at", over(F.col("__a"), F.col("__b")))
    c = clause_rows.withColumn("__at", over(F.col("start"), F.col("end")))
    touch = (F.col("start") < F.col("__b")) & (F.col("end") > F.col("__a")) & (F.col("__at") == stretch(F.greatest("start", "__a")))
    return c.join(h, ["doc_id", "__at"]).where(touch).select(*clause_rows.columns, *more)


def edges(clause_rows: DataFrame) -> DataFrame:
    """``doc_id, number, at, law, ref``: every citation; law is null for the document itself."""
    inner = clause_rows.select("doc_id", "number", F.posexplode("internal").alias("at", "ref")).select("doc_id", "number", "at", F.lit(None).cast("string").alias("law"), "ref")
    outer = clause_rows.select("doc_id", "number", F.posexplode("external").alias("at", "e")).select("doc_id", "number", (F.col("at") + 10_000).alias("at"), F.col("e.law").alias("law"), F.col("e.key").alias("ref"))
    return inner.unionByName(outer)


def resolved(edge_rows: DataFrame, clause_rows: DataFrame, titles: DataFrame) -> DataFrame:
    """``edge_rows`` with target document and clause, or a warning when there is not exactly one.

    ``titles`` is (law, doc_id): the versions in force.
    """
    laws = titles.groupBy("law").agg(F.count("*").alias("__laws"), F.min("doc_id").alias("__target"))
    keys = clause_rows.groupBy(F.col("doc_id").alias("__target"), F.col("key").alias("ref")).agg(F.count("*").alias("__keys"), F.min("number").alias("target_number"))
    own = F.when(F.col("law").isNull(), F.col("doc_id")).when(F.col("__laws") == 1, F.col("__target"))
    named = edge_rows.join(laws, "law", "left").withColumn("__target", own)
    out = named.join(keys, ["__target", "ref"], "left")
    one = F.coalesce(F.col("__keys") == 1, F.lit(False))
    warning = F.when(F.col("law").isNotNull() & F.col("__target").isNull(), "law not resolved").when(F.col("__keys").isNull(), "clause missing").when(~one, "clause repeated")
    return out.select("doc_id", "number", "at", "law", "ref", F.when(one, F.col("__target")).alias("target"), F.when(one, F.col("target_number")).alias("target_number"), warning.alias("warning"))


def backlinks(clause_rows: DataFrame) -> DataFrame:
    """``doc_id, number, back``: clauses that state an exception and cite the clause."""
    back = clause_rows.where("exception").select("doc_id", F.col("number").alias("back"), F.explode("internal").alias("key"))
    return clause_rows.select("doc_id", "number", "key").join(back, ["doc_id", "key"]).where("number <> back").select("doc_id", "number", "back")


def definitions(clause_rows: DataFrame, bodies: DataFrame) -> DataFrame:
    """``doc_id, number, by``: definitions whose quoted terms occur in a clause, and earlier scope clauses."""
    full = clause_rows.join(bodies, ["doc_id", "number"])
    heads = full.where(F.col("heading").rlike(DEFINITION)).select("doc_id", F.col("number").alias("by"), F.contains("heading", F.lit("정의")).alias("defines"), F.regexp_extract_all("body", F.lit(TERM), F.lit(1)).alias("terms"))
    each = full.select("doc_id", "number", "body").join(heads, "doc_id").where("number <> by")
    return each.where(F.when(F.col("defines"), F.exists("terms", lambda t: F.contains("body", t))).otherwise(F.col("by") < F.col("number"))).select("doc_id", "number", "by")


def walk(seeds: DataFrame, clause_rows: DataFrame, bodies: DataFrame, titles: DataFrame, budget: int = 5000, rounds: int = MOST_CLAUSES) -> DataFrame:
    """``seed, complete, n_clauses, warnings, content`` for each seed (seed, doc_id, number).

    Frontier joins gather what a seed can reach, at most ``MOST_CLAUSES`` and one
    more; a bounded group per seed then replays the queue in order.
    """
    links = resolved(edges(clause_rows), clause_rows, titles)
    neighbours = clause_rows.where("exception").select("doc_id", F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("number"), F.col("number").alias("to_number"))
    steps = [
        links.select("doc_id", "number", F.when(F.col("law").isNull(), "internal").otherwise("external").alias("kind"), F.col("at"), F.col("target").alias("to_doc"), F.col("target_number").alias("to_number"), "warning"),
        backlinks(clause_rows).select("doc_id", "number", F.lit("back").alias("kind"), F.col("back").alias("at"), F.col("doc_id").alias("to_doc"), F.col("back").alias("to_number"), F.lit(None).cast("string").alias("warning")),
        definitions(clause_rows, bodies).select("doc_id", "number", F.lit("definition").alias("kind"), F.col("by").alias("at"), F.col("doc_id").alias("to_doc"), F.col("by").alias("to_number"), F.lit(None).cast("string").alias("warning")),
        neighbours.select("doc_id", "number", F.lit("adjacent").alias("kind"), F.col("to_number").alias("at"), F.col("doc_id").alias("to_doc"), "to_number", F.lit(None).cast("string").alias("warning")),
    ]
    graph = steps[0]
    for s in steps[1:]:
        graph = graph.unionByName(s)
    graph = stored(graph, "graph")
    reach = stored(seeds.select("seed", "doc_id", "number", F.lit(0).alias("found")), "reach")
    for r in range(1, rounds + 1):
        small = reach.groupBy("seed").count().where(F.col("count") <= MOST_CLAUSES).select("seed")
        front = reach.where(F.col("found") == r - 1).join(small, "seed", "left_semi")
        new = front.join(graph.where("to_doc is not null"), ["doc_id", "number"]).select("seed", F.col("to_doc").alias("doc_id"), F.col("to_number").alias("number")).distinct()
        new = stored(new.join(reach, ["seed", "doc_id", "number"], "left_anti").withColumn("found", F.lit(r)), "reach")
        if new.isEmpty():
            break
        reach = reach.unionByName(new)
    lengths = clause_rows.join(bodies, ["doc_id", "number"]).select("doc_id", "number", F.length("body").alias("size"))
    outs = graph.groupBy("doc_id", "number").agg(F.array_sort(F.collect_list(F.struct("kind", "at", "to_doc", "to_number", "warning"))).alias("outs"))
    nodes = reach.join(lengths, ["doc_id", "number"]).join(outs, ["doc_id", "number"], "left")
    replayed = nodes.groupBy("seed").applyInPandas(lambda pdf: replay(pdf, budget), "seed bigint, complete boolean, n_clauses int, warnings string, picked array<struct<source:int,doc_id:bigint,number:int>>")
    each = replayed.select("seed", "complete", F.explode_outer("picked").alias("p")).select("seed", "complete", "p.*").join(bodies, ["doc_id", "number"], "left")
    text = each.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "number", "body"))), lambda s: s["body"]), "\n\n").alias("text"))
    return replayed.join(text, "seed").select("seed", "complete", "n_clauses", "warnings", F.when(F.col("complete"), F.col("text")).otherwise(F.concat(F.lit("(incomplete) "), "warnings")).alias("content"))


def replay(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """The queue of one seed, first in first out, on the clauses that were gathered for it."""
    seed = int(pdf["seed"].iloc[0])
    nodes = {(int(d), int(k)): (int(n), [] if o is None else list(o)) for d, k, n, o in zip(pdf["doc_id"], pdf["number"], pdf["size"], pdf["outs"])}
    home = pdf.sort_values(["found", "doc_id", "number"]).iloc[0]
    order: dict[int, int] = {}
    state: dict[tuple[int, int], bool] = {}
    queue: deque = deque()
    warnings: list[str] = []
    used, looked = 0, set()

    class Limit(Exception):
        pass

    def add(node: tuple[int, int], depth: int, required: bool = True) -> None:
        nonlocal used
        if state.get(node) or (node in state and not required):
            return
        if node not in state:
            if len(state) >= MOST_CLAUSES:
                raise Limit("too many clauses")
            if node[0] not in order and len(order) >= MOST_SOURCES:
                raise Limit("too many sources")
            cost = nodes[node][0] + (2 if node[0] in order else 1 + (22 if order else 0) + (2 if order else 0))
            if used + cost > budget:
                raise Limit("over budget")
            used += cost
            order.setdefault(node[0], len(order))
        state[node] = required
        queue.append((node, depth, required))

    def start(node: tuple[int, int], depth: int) -> None:
        add(node, depth)
        for o in nodes[node][1]:
            if o["kind"] == "adjacent":
                add((o["to_doc"], o["to_number"]), depth)

    try:
        start((int(home["doc_id"]), int(home["number"])), 0)
        while queue:
            node, depth, required = queue.popleft()
            if not required:
                continue
            for kind in ("definition", "back", "internal", "external"):
                for o in sorted((x for x in nodes[node][1] if x["kind"] == kind), key=lambda x: x["at"]):
                    if kind == "external" and depth >= HOPS:
                        warnings.append("citation too deep")
                    elif o["warning"]:
                        warnings.append(o["warning"])
                    elif kind == "external":
                        looked.add(o["to_doc"])
                        if len(looked) > LOOKUPS:
                            raise Limit("too many laws")
                        start((o["to_doc"], o["to_number"]), depth + 1)
                    else:
                        add((o["to_doc"], o["to_number"]), depth, kind != "definition")
    except Limit as e:
        warnings.append(str(e))
    picked = [{"source": order[d], "doc_id": d, "number": k} for d, k in state]
    return pd.DataFrame({"seed": [seed], "complete": [not warnings], "n_clauses": [len(state)], "warnings": ["; ".join(dict.fromkeys(warnings))], "picked": [picked]})
