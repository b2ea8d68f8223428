"""Token counts, centroid clustering and the source divergence audit against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caseloom.llm import centroids, divergence, queries, token_counts
from tests.llm.test_operators import ROWS, folder  # noqa: F401  a fixture
from tests.test_queries import rows_of

FOLDER = "/root/testdata/sf0.001"
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EXACT, PIECES = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    got, want = queries.queries()[name](spark, FOLDER), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


# token counts


def test_token_counts(spark, folder):  # noqa: F811
    got = Counter(map(tuple, token_counts.op11(spark, folder).collect()))
    want = Counter()
    for r in ROWS:
        t = r["text"] or ""
        n = len(EXACT.encode(t, add_special_tokens=False).ids)
        want[r["doc_id"], len(t.encode()), n, n > 1024] += 1
    assert got == want


def test_token_counts_of_all_documents_are_the_library_s():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    assert token_counts.Lengths(JSON)(texts) == [len(x.ids) for x in EXACT.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Lengths(MODEL, piece=500)(texts[:200]) == [len(x) for x in PIECES.encode(texts[:200], num_threads=1)]


SIGNS = ["<|endoftext|>", "'s", "'LL", " ", "  ", "\n", "\r\n", "\t", " ", "　", "​", "\x1c", "᠎", "\x85", "1", "١", "²", "é", "한", "文", "。", "，", "\U0001f600", "a", "Z9", "."]


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(SIGNS), max_size=40).map("".join)), st.sampled_from([1, 2, 3, 7]))
def test_cuts_and_words_change_no_count(text, piece):
    assert token_counts.Lengths.of(JSON)([text]) == [len(EXACT.encode(text, add_special_tokens=False).ids)]
    small = token_counts.Lengths.held.setdefault(f"{JSON} {piece}", token_counts.Lengths(JSON, piece) if f"{JSON} {piece}" not in token_counts.Lengths.held else None)
    assert small([text, text]) == token_counts.Lengths.of(JSON)([text]) * 2


def test_pieces_and_batches():
    text = "ab cd " * 50
    pieces = list(token_counts.cuts(text, [token_counts.BEFORE_SPACE], 20))
    assert "".join(pieces) == text and max(map(len, pieces)) < 30 and len(pieces) > 9
    assert list(token_counts.cuts("a" * 99, [token_counts.BEFORE_SPACE], 20)) == ["a" * 99]
    assert [len(b) for b in token_counts.by_bytes(iter(["x" * 6] * 5 + ["文" * 40, "y"]), 12)] == [2, 2, 1, 1, 1]


def test_words_are_forgotten_not_miscounted(monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN", 3)
    lengths = token_counts.Lengths(JSON)
    texts = [f"word{i} and word{i + 1} {'long' * 30}{i}" for i in range(40)] * 2
    assert lengths(texts) == [len(EXACT.encode(t, add_special_tokens=False).ids) for t in texts] and len(lengths.known) < 200


def test_unknown_vocabularies_are_refused():
    with pytest.raises(ValueError, match="no library"):
        token_counts.Lengths("vocabulary.txt")


def test_vocabularies_with_other_rules_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, texts = Tokenizer.from_file(path), [r["text"] or "" for r in ROWS[:40]]
    lengths = token_counts.Lengths(path)
    assert not lengths.patterns and lengths(texts) == [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]


# centroid clustering


def vectors() -> list[dict]:
    r = np.random.default_rng(12)
    centre = r.normal(size=(20, 64))
    rows = [{"vec_id": i, "embedding": (centre[i % 20] + r.normal(size=64) * 0.4).astype(np.float32).tolist()} for i in range(300)]
    rows += [{"vec_id": 1000 + i, "embedding": [0.25] * 64} for i in range(150)]  # one very common vector
    rows += [dict(rows[5]), dict(rows[5]), {"vec_id": 7, "embedding": [-0.1] * 64}, {"vec_id": None, "embedding": rows[9]["embedding"]}]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [math.nan], [math.inf] * 64, [-math.inf] + [0.0] * 63]
    return [x | {"row": 1, "v": "clash", "cells": 2.5} for x in rows + [{"vec_id": 2000 + i, "embedding": e} for i, e in enumerate(bad)]]


VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("row", pa.int64()), ("v", pa.string()), ("cells", pa.float64())])


def clustered(rows, k=16, rounds=3):
    kept = [(x["vec_id"], [math.floor(64 * float(c)) for c in x["embedding"]]) for x in rows if x["embedding"] and len(x["embedding"]) == 64 and all(c is not None and math.isfinite(c) for c in x["embedding"])]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        who = assign()
        groups = defaultdict(list)
        for (_, v), (_, n) in zip(kept, who, strict=True):
            groups[n].append(v)
        c = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c[n] for n in range(len(c))]
    who = assign()
    inertia = Counter()
    for d, n in who:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, who, strict=True)), key=repr)


def test_centroids(spark, tmp_path):
    rows = vectors()
    pq.write_table(pa.Table.from_pylist(rows, VECTORS), tmp_path / "embeddings.parquet")
    assert sorted(map(tuple, centroids.op12(spark, str(tmp_path)).collect()), key=repr) == clustered(rows)
    few = spark.read.parquet(str(tmp_path / "embeddings.parquet")).where("vec_id in (3, 5, 1001, 1002)")
    assert sorted(map(tuple, centroids.clusters(few).collect()), key=repr) == clustered([x for x in rows if x["vec_id"] in (3, 5, 1001, 1002)])
    for rounds in (0, 1, 6):
        got = centroids.clusters(spark.read.parquet(str(tmp_path / "embeddings.parquet")), k=5, rounds=rounds)
        assert sorted(map(tuple, got.collect()), key=repr) == clustered(rows, 5, rounds)


def test_no_table_of_the_clustering_stays(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    pq.write_table(pa.Table.from_pylist(vectors(), VECTORS), tmp_path / "embeddings.parquet")
    centroids.op12(spark, str(tmp_path)).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_cells_bound_every_distance():
    r = np.random.default_rng(2)
    v = np.concatenate([(r.normal(size=(500, 6)) * 30).astype(np.int64), r.integers(-5000, 5000, (20, 6))])
    file = centroids.Cells(np.quantile(v, centroids.CUTS, axis=0).T.astype(np.int64), v.min(0), v.max(0))
    c = (r.normal(size=(9, 6)) * 40).astype(np.int64)
    cells = centroids.unpacked(pa.array([x.tobytes() for x in centroids.packed(file.of(v))]), 6)
    assert (cells == file.of(v)).all()
    least, most = file.tables(c)
    exact = ((v[:, None] - c[None]) ** 2).sum(2)
    low, high = (sum(t[d][cells[:, d]] for d in range(6)) for t in (least, most))
    excess = exact - ((v - c.sum(0) // len(c)) ** 2).sum(1)[:, None]
    assert (low <= excess).all() and (excess <= high).all()
    may = file.candidates(cells, c)
    assert may[np.arange(len(v)), exact.argmin(1)].all() and may.sum(1).mean() < 6  # most centroids are ruled out unseen


def test_components_too_large_for_a_long_distance_end_the_job(spark):
    df = spark.createDataFrame([(i, [1e30] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="no long distance"):
        centroids.clusters(df)


# source divergence


def test_pointer_sort_agrees_with_counting():
    r = random.Random(4)
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 9, "abcdefgh" * 9 + "x", "abcdefgh" * 8, "été", "Z", "文" * 30] + ["".join(r.choice("ab") for _ in range(r.randrange(1, 30))) for _ in range(200)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(60))).encode() for _ in range(120)] + [b"", b"1 2 3"]
    groups = np.array([i % 3 for i in range(len(texts))])
    got = {(t, g): (n, d) for t, g, n, d in zip(*divergence.counted(texts, groups), strict=True)}
    n, docs = Counter(), Counter()
    for i, t in enumerate(texts):
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.decode())
        keys = [(w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode(), i % 3) for w in found]
        n.update(keys)
        docs.update(set(keys))
    assert got == {k: (n[k], docs[k]) for k in n}
    assert divergence.counted([b"1 2", b""], np.array([0, 1]))[0] == []


def test_shares_are_exact_beyond_64_bits():
    for n, whole in ((1, 3), (10**15, 10**15), (7 * 10**14 + 1, 8 * 10**15), (2, 8 * 10**15), (0, 5)):
        assert divergence.share(np.array([n]), np.array([whole]))[0] == 1 + 10**9 * n // whole


def audited(rows, min_docs=10, top=10):
    terms = defaultdict(lambda: defaultdict(Counter))
    docs = defaultdict(Counter)
    for r in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r["text"] or "")
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found]
        terms[r["lang"] or ""][r["source"] or ""].update(found)
        docs[r["lang"] or ""].update(set(found))
    out = []
    for lang, sources in terms.items():
        kept = [w for w, n in docs[lang].items() if n >= min_docs]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        q, p = share(sum(sources.values(), Counter())), {s: share(c) for s, c in sources.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in sources if t != s)
            best = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if sources[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, x[2], -x[0], i) for part, found in (("pair", pairs), ("term", best)) for i, x in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_bytes,shard,block", [(8 << 20, 4096, 64), (2000, 7, 2)])
def test_divergence(spark, folder, monkeypatch, slice_bytes, shard, block):  # noqa: F811
    monkeypatch.setattr(divergence, "SLICE", slice_bytes)
    monkeypatch.setattr(divergence, "BLOCK", block)
    got = divergence.audit(spark.read.parquet(f"{folder}/documents.parquet"), shard=shard)
    assert sorted(map(tuple, got.collect())) == audited(ROWS)


def test_languages_without_kept_terms_have_pairs_of_zero(spark):
    rows = [{"lang": la, "source": s, "text": t} for la, s, t in [("en", "a", "one"), ("en", "b", None), ("en", None, ""), (None, "a", "x" * 100_000), ("de", "c", "drei")]]
    got = divergence.audit(spark.createDataFrame([(r["lang"], r["source"], r["text"]) for r in rows], "lang string, source string, text string"))
    want = audited(rows)
    assert sorted(map(tuple, got.collect())) == want and {x[4] for x in want} == {0} and len(want) == 6
