"""Contracts that SQL over the given tables does not reach: Korean texts, boundaries, invariants."""

from __future__ import annotations

import datetime
import glob
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.functions import clauses as fc
from caseloom.functions import json_text, text, vectors
from caseloom.operators import curation, dedup, evidence, lifecycle, rules, windows
from caseloom.sources import files
from caseloom.sources.scratch import root


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def test_redaction_takes_resident_numbers_first(spark):
    assert one(spark, "주민 900101-1234567 끝", text.redact) == f"주민 {text.REDACTED} 끝"
    assert one(spark, "전화 010-1234-5678, a.b@c.co", text.redact) == f"전화 {text.REDACTED}, {text.REDACTED}"
    assert one(spark, None, text.redact) == ""


def test_cleaning_knows_wide_blanks(spark):
    assert one(spark, "　가 나\t\n다 ", text.clean) == "가 나 다"


PAIRS = [("a b", "a  b", True, True), ("a b", "ab", False, False), ("a\nb", "ab", False, True), ("a\n b", "ab", False, True), ("a\n\nb", "ab", False, False), ("가 나", "가\n나", True, True)]


@pytest.mark.parametrize("a,b,plain,native", PAIRS)
def test_identity(spark, a, b, plain, native):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    for wraps, want in ((None, plain), (F.lit(True), native)):
        got = df.select(text.identity(F.col("a"), wraps).alias("p"), text.identity(F.col("b"), wraps).alias("q")).select(text.equivalent(F.col("p"), F.col("q")).alias("e")).first().e
        assert got == want


def test_batch_dedup_is_first_wins_and_idempotent(spark):
    rows = spark.createDataFrame([(1, "u", "a b"), (2, "u", "a  b"), (3, "v", "a b"), (4, "u", "ab"), (5, None, "a b"), (6, None, "a b ")], "id long, owner string, t string").withColumn("p", text.identity(F.col("t")))
    kept = dedup.batch_dedup(rows, "id", "p", "owner")
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4, 5]
    assert dedup.batch_dedup(kept, "id", "p", "owner").count() == 4


CATALOGUE = {"주택·건축": ["층간소음", "건축", "건축구조"], "환경·위생": ["소음", "대기", "미세먼지", "공장소음"], "교통·국토": ["버스", "인도", "공사"]}


def rule(spark, content):
    df = spark.createDataFrame([(content,)], "t string")
    return rules.classified(df, "t", CATALOGUE).select("rule").first().rule


def test_rules_in_context(spark):
    assert rule(spark, "층간 소음이 심해요").category == "주택·건축"
    assert rule(spark, "층간 소음이 심해요").top == 3
    assert rule(spark, "버스 버스 버스").top == 1
    assert rule(spark, "은행 대기 시간이 길다").category == "기타"
    assert rule(spark, "은행 대기 시간이 길고 한참 뒤 이야기로 넘어가서 오늘 아침에는 대기 오염이 심하다").category == "환경·위생"
    assert rule(spark, "상품 인도 기한이 지났다").category == "기타"
    assert rule(spark, "보도블록이 깨진 인도 통행이 불편").category == "교통·국토"
    assert rule(spark, "건축구조 검토").top == 3
    assert rule(spark, "공장 밤마다 소음").top == 3
    assert rule(spark, "보증금을 못 받았다").reasons == ["no_keyword", "ambiguous_deposit"]
    assert rule(spark, "").reasons == ["no_keyword"] and not rule(spark, "").needs_model


def test_versions_in_force(spark):
    d = datetime.date
    rows = [("a", 1, d(2020, 1, 1), "v"), ("a", 2, d(2021, 1, 1), "w"), ("a", 3, d(2030, 1, 1), "x"), ("b", 4, d(2030, 1, 1), ""), ("c", 5, None, "v"), ("d", 6, None, "v"), ("d", 7, d(2020, 1, 1), "w"), ("e", 8, None, "v"), ("e", 9, d(2030, 1, 1), "v"), ("f", 10, d(2020, 1, 1), "v"), ("f", 11, d(2020, 1, 1), "w"), ("g", 12, d(2030, 1, 1), "v"), ("g", 13, d(2031, 1, 1), "w")]
    out = evidence.versions(spark.createDataFrame(rows, "g string, id long, d date, v string"), F.col("g"), "id", F.col("d"), F.col("v"), F.lit("2025-01-01").cast("date")).collect()
    assert {r.id for r in out if r.eligible} == {2, 5, 8}
    assert {r.g for r in out if r.warning} == {"d", "f"}


LAW = "법률\n제1조(목적) 이 법은 정한다.\n제2조(정의) \"소음\"이라 한다.\n제3조(기준) 소음은 제1조와 「환경법」 제5조에 따른다. 다만, 전조는 제외한다.\n별표 2\n표"


def test_clauses():
    got = list(fc.clauses(LAW))
    assert [u["key"] for u in got] == ["preamble", "제1조", "제2조", "제3조", "별표2"]
    third = got[3]
    assert third["internal"] == ["제3조", "제1조", "제2조"] and third["external"] == [{"law": "환경법", "key": "제5조"}] and third["exception"]
    assert "".join(LAW[u["start"] : u["end"]] for u in got) == LAW
    assert [u["key"] for u in fc.clauses("")] == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="가나 .\n제1조(a)0", max_size=400), st.integers(4, 40))
def test_spans_cover_a_text_without_loss(t, target):
    spans = list(fc.spans(t, target, fc.word_spans))
    assert "".join(t[a:b] for a, b, _ in spans) == t
    assert all(n <= target or b - a == 1 for a, b, n in spans)


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=200), st.integers(12, 60))
def test_byte_pieces_join_again(t, most):
    assert "".join(fc.byte_pieces(t, most)) == t


def test_walk_shares_a_branch_and_stops_at_the_budget(spark):
    a = "제1조(가) 제2조와 제3조에 따른다.\n제2조(나) 제4조에 따른다.\n제3조(다) 제4조에 따른다.\n제4조(라) 끝."
    docs = spark.createDataFrame([(1, a), (2, "제1조(가) 「없는 법」 제1조에 따른다.")], "doc_id long, text string")
    rows = evidence.clause_table(docs)
    bodies = rows.join(docs, "doc_id").select("doc_id", "number", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("body"))
    titles = spark.createDataFrame([("하나", 1)], "law string, doc_id long")
    seeds = spark.createDataFrame([(1, 1, 0), (2, 2, 0)], "seed long, doc_id long, number int")
    out = {r.seed: r for r in evidence.walk(seeds, rows, bodies, titles).collect()}
    assert out[1].complete and out[1].n_clauses == 4 and out[1].content.count("제4조(라)") == 1
    assert not out[2].complete and "law not resolved" in out[2].warnings
    short = evidence.walk(seeds.where("seed = 1"), rows, bodies, titles, budget=40).first()
    assert not short.complete and "over budget" in short.warnings


@pytest.mark.parametrize("total,incoming,purge", [(9998, 1, 0), (9999, 1, 0), (10000, 1, 100), (10000, 100, 100), (10000, 150, 250), (10500, 1, 501)])
def test_retention(spark, total, incoming, purge):
    assert spark.range(1).select(windows.purge_size(F.lit(total), F.lit(incoming)).alias("p")).first().p == purge


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 30), min_size=1), st.integers(0, 120), st.integers(1, 3))
def test_quota_fills_evenly(sizes, wanted, repeats):
    q = curation.quota(sizes, wanted, repeats)
    room = {k: v * repeats for k, v in sizes.items()}
    assert sum(q.values()) == min(wanted, sum(room.values())) and all(q[k] <= room[k] for k in sizes)
    open_ = [q[k] for k in sizes if q[k] < room[k]]
    assert not open_ or max(q.values()) - min(open_) <= 1


def test_balanced_pick_grows_without_change(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(100)], "id long, kind string")
    pick = lambda n: {r.id for r in curation.pick_balanced(rows, "kind", "id", n).collect()}
    assert pick(10) < pick(20) < pick(40)
    again = curation.pick_balanced(rows, "kind", "id", 90, 2).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in again} == {"a": 50, "b": 40}


def test_split_is_the_big_integer_result(spark):
    import hashlib

    for g in ("a", "민원", "7"):
        assert one(spark, g, text.bucket) == int(hashlib.sha1(g.encode()).hexdigest(), 16) % 10_000


def test_tool_calls_and_json(spark):
    raw = '<|channel>t<channel|>x <|tool_call>call:insert{title:<|"|>a, b:c<|"|>,ok:true}<tool_call|> y'
    assert one(spark, raw, json_text.tool_call).arguments == '{"ok": true, "title": "a, b:c"}'
    assert one(spark, 'so: {"a": {"b": 1}} end', json_text.object_in) == '{"a": {"b": 1}}'
    assert one(spark, "[1]", json_text.object_in) is None and one(spark, '{"a": 1', json_text.object_in) is None


def test_numbers_and_dates(spark):
    assert one(spark, "1,500원 03일 2.50 50만", text.numbers_in) == ["1500", "3", "2.50", "50"]
    assert str(one(spark, "시행 2026. 2. 28.", text.date_in)) == "2026-02-28" and one(spark, "2026-02-29", text.date_in) is None


def test_vectors(spark):
    rows = [([3.0, 4.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([0.0, 0.0],)]
    got = [r.u for r in spark.createDataFrame(rows, "v array<float>").select(vectors.unit(F.col("v"), 2).alias("u")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1:] == [None] * 4


def test_csv_of_ragged_records_and_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('제목,내용\n"가 ""나""","줄1\n줄2"\n\n짧다\n하나,둘,셋,"넷,다섯"\n'.encode())
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), ["제목", "내용"])
    got = files.surplus(rows, ["제목", "내용"]).select("제목", "내용", "extra").collect()
    assert [tuple(r) for r in got] == [('가 "나"', "줄1\n줄2", []), ("짧다", None, []), ("하나", "둘", ["셋", "넷,다섯"])]
    contents = [("u", "가나다".encode()), ("b", b"\xef\xbb\xbfabc"), ("c", "가나다".encode("cp949")), ("cut", ("a" * 65535 + "가").encode())]
    out = {r.path: r.encoding for r in files.sniffed(spark.createDataFrame([(k, bytearray(v)) for k, v in contents], "path string, content binary")).collect()}
    assert out == {"u": "utf-8", "b": "utf-8-sig", "c": "cp949", "cut": "utf-8"}


def test_status_machine_rejects_illegal_moves(spark):
    e = spark.createDataFrame([(1, 1, "done"), (1, 2, "in progress"), (1, 3, "done"), (1, 4, "received"), (2, 1, "cancelled"), (2, 2, "in progress")], "id long, at long, wanted string")
    assert {r.id: (r.state, r.rejected) for r in lifecycle.fold(e, "id", "at", "wanted").collect()} == {1: ("done", 2), 2: ("cancelled", 1)}


def test_nearest_vectors_are_exact(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(200, 8))
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "v": v.tolist()}))
    got = evidence.top_k(df.where("id < 3").withColumnRenamed("id", "q"), df, "q", "id", "v", 4).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(3):
        assert [x.id for x in sorted((x for x in got if x.q == q), key=lambda x: x.place)] == np.argsort(-(u @ u[q]), kind="stable")[:4].tolist()


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select("id", (F.col("id") * 37 % 101).cast("double").alias("score"), F.lit("g").alias("g"))
    fuse = lambda n: sorted((r.id, round(r.fused, 9)) for r in windows.reciprocal_rank_fusion({"a": rows.repartition(n), "b": rows.where("id < 90").repartition(n)}, "id", "score", ["g"]).collect())
    assert fuse(1) == fuse(7)


def test_chunks_take_the_target_less_two_tokens():
    """From the first token to the one ``target - 3`` after it."""
    got = [n for _, _, n in fc.spans(" ".join(["가"] * 50), 20, fc.word_spans)]
    assert got == [18, 18, 14]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='ab"\\\n\t\x01가é😀', max_size=120), st.integers(12, 40))
def test_byte_pieces_fit_and_are_as_long_as_they_can_be(t, most):
    size = lambda x: len(json.dumps(x, ensure_ascii=False).encode()) - 2
    pieces = list(fc.byte_pieces(t, most))
    assert all(size(p) <= most for p in pieces) and all(size(p + q[0]) > most for p, q in zip(pieces, pieces[1:]))


def test_sets_meet_in_one_cell_whatever_the_blocks(spark, tmp_path):
    r = random.Random(17)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(3, 160))) for _ in range(30)]
    texts = base + [t[: len(t) * 9 // 10] + "xyz" for t in base] + [t.replace("a", "e", 1) for t in base] + ["ab", "a", "", None, base[0], base[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: frozenset(c[k : k + 3] for k in range(max(1, len(c) - 2))) for i, t in enumerate(texts) for c in [" ".join((t or "").split())]}
    heads = {}
    for i, s in sorted(sets.items()):
        heads.setdefault(s, i)
    want = {(heads[s], i, len(s), len(s)) for i, s in sets.items() if heads[s] != i}
    want |= {(a, b, len(x & y), len(x | y)) for x, a in heads.items() for y, b in heads.items() if a < b and 100 * len(x & y) >= 72 * len(x | y)}
    assert len(want) > 30
    for block in (2, 7, 1000):
        got = [tuple(x) for x in dedup.near_pairs(docs, "doc_id", "text", 72, 100, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_similar_pairs_are_neither_stored_nor_dealt(spark, monkeypatch):
    """Documents of which any two are similar: what steps leave for later steps has no row for a pair."""
    words = [f"w{i:03d}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[:i] + words[i + 1 :])) for i in range(60)], "doc_id long, text string")
    rows = {}

    def counting(df, name, stored=dedup.stored):
        out = stored(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(dedup, "stored", counting)
    assert dedup.near_pairs(docs, "doc_id", "text", 72, 100).count() == 60 * 59 // 2
    assert max(rows.values()) == 60


def test_sets_lie_once_whatever_the_blocks(spark):
    """Cells are dealt by the names of blocks: what is stored and dealt has each set once, however many others it meets."""
    words = [f"w{i:03d}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[:i] + words[i + 1 :])) for i in range(60)], "doc_id long, text string")
    out = dedup.near_pairs(docs, "doc_id", "text", 72, 100, block=4)
    assert out.count() == 60 * 59 // 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bits" not in plan and "rest" not in plan
    newest = max(glob.glob(f"{root(spark)}/gram-blocks-*"), key=os.path.getmtime)
    blocks = spark.read.parquet(newest).groupBy("band", "part").count().collect()
    assert sum(b["count"] for b in blocks) == 60 and len(blocks) > 8


def test_a_block_that_is_not_whole_is_an_error(tmp_path):
    os.makedirs(tmp_path / "band=1" / "part=0")
    pd.DataFrame({"id": [1, 2], "n": [3, 3], "bits": [bytes(1024)] * 2, "rest": [bytes(24), bytes(24)]}).to_parquet(tmp_path / "band=1" / "part=0" / "a.parquet")
    assert dedup.block_of(str(tmp_path), 1, 0, 2).n.tolist() == [3, 3]
    with pytest.raises(OSError):
        dedup.block_of(str(tmp_path), 1, 0, 3)
    with pytest.raises(OSError):
        dedup.block_of(str(tmp_path), 1, 1, 3)


def test_earliest_equivalents_come_from_class_heads(spark):
    r = random.Random(4)
    forms = ["a b c", "a  b c", "ab c", "a\nb c", "x y", "xy", "x\ny", "z"]
    rows = [(i, r.choice("st"), r.choice(forms)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, scope string, text string").withColumn("profile", text.identity(F.col("text"), F.lit(True)))
    pairs = dedup.equivalent_pairs(df, "id", "profile", "scope").groupBy("later").agg(F.min("earlier").alias("m"))
    got = dedup.first_equivalent(df, "id", "profile", "scope")
    assert {tuple(x) for x in got.select("id", "duplicate_of").collect()} == {tuple(x) for x in pairs.collect()}


def test_lines_keep_their_numbers_over_splits_and_files(spark, tmp_path):
    """Files cut into many splits; blank lines count, and long ones lie across a cut."""
    want = set()
    for name in ("a", "b"):
        lines = [("" if i % 7 == 0 else f"{name}{i} " + "x" * (i % 50)) for i in range(1, 400)]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
        want |= {(name, i, x) for i, x in enumerate(lines, 1)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = files.numbered(spark, str(tmp_path))
        rows = got.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.file.rsplit("/", 1)[1][0], r.line, r.value) for r in rows} == want and len(rows) == len(want)


def test_chunks_that_do_not_cover_a_text_are_told(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (2, "abcdef"), (3, "abcdef"), (4, "abcdef"), (5, ""), (6, None), (7, "x")], "doc_id long, text string")
    chunks = spark.createDataFrame(
        [(1, 0, 0, 3, "abc"), (1, 1, 3, 6, "def"), (2, 0, 0, 3, "abc"), (2, 1, 4, 6, "ef"), (3, 0, 0, 3, "abX"), (3, 1, 3, 6, "def"), (4, 0, 0, 3, "abc")], "doc_id long, chunk int, start int, end int, content string"
    )
    got = {r.doc_id: (r.proven, r.n_chunks) for r in evidence.span_proof(chunks, docs).collect()}
    assert got == {1: (True, 2), 2: (False, 2), 3: (False, 2), 4: (False, 1), 5: (True, 0), 6: (True, 0), 7: (False, 0)}
