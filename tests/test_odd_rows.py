"""Queries against their SQL on rows that the given tables seldom have."""

from __future__ import annotations

import duckdb

from caseloom.plans import catalog


def agrees(spark, folder, name, documents):
    """Both sides on ``documents``, as lists of sorted rows that must be equal; the rows come back."""
    rows = [(i, x, "en", "s", len(x)) for i, x in documents.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = catalog.queries()[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(f'"{c}"' for c in got.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    got = [tuple(x) for x in got.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_records_break_rules_by_their_texts(spark, tmp_path):
    """A number cut off by the summary, an empty text, a first word past what is seen, a number that the text has after all."""
    texts = {14: "x" * 37 + " 1234567", 15: "", 16: "a" * 1600, 19: "00987,654,321 is said", 22: "#absent# is here", 25: " leading blank"}
    got = agrees(spark, tmp_path, "analysis_record_rules", texts)
    assert {(14, "C3"), (15, "C2"), (15, "C3"), (16, "C6")} <= set(got)
    assert not {(19, "C3"), (22, "C6")} & set(got)


CITING = {1: 'a\nb "token"\nc', 2: 'a\nb „token“\nc\nd\n"x" e\n', 3: "", 4: 'a\nb 「 law  9 」\nc', 5: "a\nb\nc 전조\nd 다음 조\n9법", 6: 'a\nb "tok"\n', 8: 'a\nb 법'}


def test_a_quoted_name_before_a_clause_is_another_law(spark, tmp_path):
    got = agrees(spark, tmp_path, "clause_edges", CITING)
    assert dict((d, c) for d, _, c in got)[1] == 0


def test_a_quoted_name_before_a_clause_is_another_law_in_sql(spark, tmp_path):
    got = agrees(spark, tmp_path, "clause_edges_in_sql", CITING)
    assert dict((d, c) for d, _, c in got)[1] == 0


def test_all_terms_of_a_definition_support_clauses(spark, tmp_path):
    """A second quoted term, one that lies between two quoted ones, and a clause without any."""
    texts = {1: 'first "key" here\nno term\nthe end\na key turns', 2: "a\nthen", 3: "", 4: '"a" b "c"\n b \nxcx'}
    assert (1, 3, 0) in agrees(spark, tmp_path, "definition_support", texts)


def test_clauses_after_a_quoted_name_resolve_as_another_law(spark, tmp_path):
    got = agrees(spark, tmp_path, "reference_resolution", CITING | {9: 'a\nb "law 5"\nc', 12: "\n".join("abcdefghijkl")})
    assert (1, 1, "token", "제3조", None, None, "law not resolved") in got and (9, 1, "law 5", "제3조", 5, 2, None) in got


def test_texts_reach_python_in_batches_of_bounded_size(spark, tmp_path):
    """Whatever the session had before: 10,000 whole texts at once, and what is made of them, are more than a worker should hold."""
    from caseloom.operators import evidence
    from caseloom.plans.registry import Tables
    from caseloom.plans.retrieval import parsed
    from caseloom.plans.texts import identity_profile

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: spark.conf.get(k) for k in (rows, size)}
    docs = spark.createDataFrame([(1, "a\nb", "en")], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tables = Tables(spark, str(tmp_path))
    try:
        for use in (lambda: evidence.clause_table(docs), lambda: evidence.byte_table(docs, 700), lambda: evidence.chunk_table(docs, 400), lambda: parsed(tables), lambda: identity_profile(tables)):
            spark.conf.set(rows, "10000")
            spark.conf.set(size, str(1 << 30))
            use()
            assert int(spark.conf.get(rows)) <= 1000 and 0 < int(spark.conf.get(size).rstrip("b")) <= 16 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_queries_visit_rings_slice_by_slice(spark, monkeypatch):
    """No batch of visits has more rows than it may, and the nearest rows are the exact ones."""
    import numpy as np
    import pandas as pd

    from caseloom.operators import vector_index

    monkeypatch.setattr(vector_index, "VISITS", 5, raising=False)
    monkeypatch.setattr(vector_index, "CELLS", 30, raising=False)
    v = np.random.default_rng(0).normal(size=(200, 8))
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "v": v.tolist()}))
    index = vector_index.VectorIndex(df, "id", "v", 8, centres=6, part=20)
    asked = vector_index.unit_rows(df.where("id < 9").withColumnRenamed("id", "q"), "q", "v", 8).selectExpr("q", "v", "cast(null as double) as least")
    sizes = index.visits(asked.coalesce(1), "q", 40).mapInArrow(lambda batches: (b.select(["q"]) for b in batches), "q long")
    assert sizes.count() > 9
    held = []

    class Seen:
        def mapInArrow(self, run, schema):
            held.append(run)

    class Asked:
        dtypes = asked.dtypes

        def select(self, *columns):
            return Seen()

    index.visits(Asked(), "q", 40)
    batches = asked.coalesce(1).toArrow().to_batches()
    assert max(b.num_rows for b in held[0](iter(batches))) <= 5
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = index.top_k(df.where("id < 9").withColumnRenamed("id", "q"), "q", 4).collect()
    for q in range(9):
        assert [x.id for x in sorted((x for x in got if x.q == q), key=lambda x: x.place)] == np.argsort(-(u @ u[q]), kind="stable")[:4].tolist()


def test_profiles_meet_once_for_two_classes(spark, monkeypatch):
    """Copies: pairs are spelled out by key, of profiles only those of two classes are compared."""
    from pyspark.sql import functions as F

    from caseloom.functions import text
    from caseloom.operators import dedup

    forms = ["a b c", "a\nb c"]
    df = spark.createDataFrame([(i, forms[i % 2]) for i in range(60)], "id long, text string").withColumn("profile", text.identity(F.col("text"), F.lit(True)))
    rows = {}

    def counting(df, name, stored=dedup.stored):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(dedup, "stored", counting)
    got = dedup.equivalent_pairs(df, "id", "profile")
    assert {tuple(x) for x in got.collect()} == {(a, b) for a in range(60) for b in range(a + 1, 60)}
    assert rows == {"profiles": 60, "class-pairs": 1}


def test_terms_are_counted_on_the_smaller_side_only(spark):
    from caseloom.operators import dedup

    left = {i: [f"t{(i * k) % 11}" for k in range(1, 2 + i % 5)] + ["own"] * (i % 2) for i in range(40)}
    right = {i: [f"t{(i + k) % 11}" for k in range(1, 2 + i % 4)] for i in range(12)}
    left, right = ({k: sorted(set(v)) for k, v in x.items()} for x in (left, right))
    a, b = spark.createDataFrame(list(left.items()), "a long, g array<string>"), spark.createDataFrame(list(right.items()), "b long, g array<string>")
    out = dedup.similar(a, b, "a", "b", "g", 1, 2)
    want = {(i, j, len(set(x) & set(y)), len(set(x) | set(y))) for i, x in left.items() for j, y in right.items() if 2 * len(set(x) & set(y)) >= len(set(x) | set(y))}
    assert {tuple(r) for r in out.collect()} == want and len(want) > 10
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 4


def test_texts_come_back_from_csv_as_they_were(spark, tmp_path):
    """Blanks at the ends, an empty text beside none, and all short texts of characters that a CSV parser may take for its own."""
    import itertools

    short = ["".join(x) for n in range(5) for x in itertools.product('a"\0,\n\r \\', repeat=n)]
    got = agrees(spark, tmp_path, "csv_record_scan", dict(enumerate([*short, "\t tab\t", "\ufeffx", "\u00a0x\u3000", '"x"' * 400_000])))
    assert len(got) == len(short) + 4


def test_csv_tells_an_empty_text_from_none(spark, tmp_path):
    from caseloom.plans.registry import Tables
    from caseloom.plans.lifecycles import csv_of
    from caseloom.sources import files

    rows = [("1", None), ("2", ""), ("3", " ")]
    path, null = csv_of(Tables(spark, str(tmp_path)), spark.createDataFrame(rows, "id string, text string"))
    assert sorted((r.id, r.text) for r in files.read_csv(spark, path, ["id", "text"], null=null).collect()) == rows


def test_blank_texts_have_no_quality(spark):
    """As in the reference, whatever the share of readable characters of nothing would be."""
    from pyspark.sql import functions as F

    from caseloom.functions import text

    rows = [(x,) for x in (None, "", "  ", "\n 　\x0b")]
    assert [r.q for r in spark.createDataFrame(rows, "x string").select(text.quality(F.col("x"), ["tion"]).alias("q")).collect()] == [0.0] * 4
