"""Whole inputs: what lies past a prefix, a cap or a block counts as well."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from caseloom.operators import evidence, lifecycle, windows
from caseloom.plans import catalog


def run(spark, folder, name, **tables):
    """The rows of a query over tables of (rows, schema)."""
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return catalog.queries()[name](spark, str(folder)).collect()


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def grams(text):
    return {text[i : i + 3] for i in range(max(len(text) - 2, 1))}


def test_near_duplicates_are_judged_on_whole_texts(spark, tmp_path):
    same_opening = [(1, words(1, 70) + " " + words(2, 200)), (2, words(1, 70) + " " + words(3, 200))]
    same_rest = [(3, words(4, 70) + " " + words(5, 500)), (4, words(6, 70) + " " + words(5, 500))]
    docs = [*same_opening, *same_rest, (5, words(7, 20)), (6, words(7, 20))]
    got = run(spark, tmp_path, "near_duplicate_pairs", documents=(docs, "doc_id long, text string"))
    sets = {d: grams(t) for d, t in docs}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 72 * len(sets[a] | sets[b])}
    assert {(r.a, r.b, r.shared, r.either) for r in got} == want and {x[:2] for x in want} == {(3, 4), (5, 6)}


def test_lines_past_the_thousandth_do_not_meet_the_next_document(spark, tmp_path):
    docs = [(1, "\n".join(["x"] * 1004 + ["alpha beta gamma"])), (2, "\n".join(["y"] * 4 + ["delta epsilon zeta eta"]))]
    got = run(spark, tmp_path, "benchmark_leakage", documents=(docs, "doc_id long, text string"), benchmark=([(7, "alpha beta gamma"), (8, "delta epsilon zeta eta")], "item_id long, text string"))
    assert sorted((r.item_id, r.shared, r.either) for r in got) == [(7, 3, 3), (8, 4, 4)]
    assert len({r.line_id for r in got}) == 2 and {r.line_id for r in got if r.item_id == 8} == {2005}


def test_terms_late_in_a_line_are_supported(spark, tmp_path):
    docs = [(1, "a title\n" + "x" * 150 + " the end\nnone here"), (400, "a title\nthe end")]
    got = run(spark, tmp_path, "definition_support", documents=(docs, "doc_id long, text string"))
    assert {(r.doc_id, r.number, r.by) for r in got} == {(1, 1, 0), (400, 1, 0)}


def test_citations_reach_laws_past_the_300th(spark, tmp_path):
    lines = [f"line {i}" for i in range(5)]
    docs = [(d, "\n".join(lines)) for d in (50, 354, 400)]
    got = {r.seed: r for r in run(spark, tmp_path, "citation_walk", documents=(docs, "doc_id long, text string"))}
    # line 4 of document d cites law (7 d + 4) % 401: 354 for document 50, which cites 76 in turn
    assert got[50].n_clauses > got[400].n_clauses


def test_cases_keep_whole_turns(spark, tmp_path):
    turns = [(1, 1, "user", "b" * 80), (4, 1, "user", "c" * 80), (4, 2, "user", "d" * 80)]
    got = run(spark, tmp_path, "case_pages", conversations=(turns, "conv_id long, turn long, role string, text string"))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert {(r.file, r.number, r.body) for r in got} == {("1", "001", md5("b" * 80)), ("4", None, md5("c" * 80 + "\n" + "d" * 80))}


def test_the_queue_has_no_cap(spark, tmp_path):
    docs = [(i, 5000 if i % 50 == 0 else 10) for i in range(2000)]
    got = run(spark, tmp_path, "queue_order", documents=(docs, "doc_id long, n_chars long"))
    assert [(r.doc_id, r.is_long) for r in got] == sorted(((d, n > 4000) for d, n in docs), key=lambda x: (x[1], x[0]))


def test_any_number_of_queries_is_answered(spark):
    r = np.random.default_rng(3)
    rows = r.normal(size=(60, 4)).round(2)
    asked = r.normal(size=(4500, 4)).round(2)
    table = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, embedding array<double>")
    got = defaultdict(list)
    for x in evidence.top_k(table(asked, "query_id"), table(rows, "vec_id"), "query_id", "vec_id", "embedding", 3).collect():
        got[x.query_id].append((x.place, x.score))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = -np.sort(-(unit(asked) @ unit(rows).T), axis=1)[:, :3]
    assert len(got) == 4500 and all(np.allclose([s for _, s in sorted(got[i])], want[i]) for i in range(4500))


def test_histories_are_streamed(spark):
    r = random.Random(5)
    e = [(r.choice([1, 1, 1, 2, None]), i, r.random(), r.random() < 0.2, r.choice(["in progress", "done", "received", None])) for i in range(600)]
    df = spark.createDataFrame(e, "k long, id long, v double, bad boolean, wanted string")
    average, breaker, fold = windows.running_average(df, "k", "id", "v", 0.3), lifecycle.with_breaker(df, "id", F.col("bad"), "k", "id", 7), lifecycle.fold(df, "k", "id", "wanted")
    for out in (average, breaker, fold):
        assert "collect_list" not in out._jdf.queryExecution().toString()
    want_average, want_breaker, want_fold, now, until = {}, {}, {}, {}, defaultdict(lambda: -1)
    for k, i, v, bad, wanted in e:
        now[k] = v if k not in now else 0.3 * v + 0.7 * now[k]
        want_average[k, i] = now[k]
        want_breaker[k, i] = "skipped" if i < until[k] else "failed" if bad else "ok"
        until[k] = i + 7 if want_breaker[k, i] == "failed" else until[k]
        state, rejected = want_fold.get(k, ("received", 0))
        want_fold[k] = (wanted, rejected) if wanted in lifecycle.MOVES[state] else (state, rejected + 1)
    got = {(x.k, x.id): x.average for x in average.collect()}
    assert got.keys() == want_average.keys() and all(abs(got[x] - want_average[x]) < 1e-12 for x in got)
    assert {(x.k, x.id): x.outcome for x in breaker.collect()} == want_breaker
    assert {x.k: (x.state, x.rejected) for x in fold.collect()} == want_fold
