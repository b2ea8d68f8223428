"""Table functions in SQL, clauses under many hits, and chunks against a plain walk over whole documents."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import clauses as fc
from caseloom.functions import tables
from caseloom.operators import curation, evidence
from caseloom.plans import catalog
from caseloom.plans.registry import Tables
from caseloom.plans.retrieval import laws

FOLDER = "/root/testdata/sf0.001"


def walked(text, target):
    """Chunks one after another: the last line or sentence end or unit start within reach, else the word that uses up the target."""
    starts = [m.start() for m in fc.HEADING.finditer(text)]
    limit = target if starts else min(target, fc.UNTITLED)
    units = [*fc.outline(text), len(text)]
    edges = sorted({*units, *(m.end() for m in fc.EDGE.finditer(text))})
    word_ends = [m.end() for m in re.finditer(r"\S+", text)] or [len(text)]
    at, out = 0, []
    while at < len(text):
        ahead = [e for e in word_ends if e > at]
        reach = ahead[limit - fc.SPARE] if len(ahead) > limit - fc.SPARE + 1 else len(text)
        stop = min(max(reach, at + 1), next(u for u in units if u > at))
        end = max((e for e in edges if e <= stop), default=0)
        end = end if end > at else stop
        while len(text[at:end].split()) > limit and end - at > 1:
            end = at + max((end - at) * 9 // 10, 1)
        out.append((at, end))
        at = end
    return out


def test_chunks_agree_with_a_plain_walk(spark):
    rows = {}
    for r in catalog.queries()["chunk_spans"](spark, FOLDER).collect():
        rows.setdefault(r.doc_id, []).append((r.chunk, r.start, r.end, r.tokens))
    texts = {r.doc_id: r.text for r in laws(Tables(spark, FOLDER)).collect()}
    assert len(rows) == len([t for t in texts.values() if t]) >= 200
    for d, t in texts.items():
        mine = sorted(rows.get(d, []))
        assert [x[1:3] for x in mine] == walked(t, 400), d
        assert all(x[3] == len(t[x[1] : x[2]].split()) for x in mine)


def test_table_functions_give_the_rows_of_the_operators(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, "제1조(목적) 가나\n제2조(정의) 제1조에 따른다. 「다른 법」 제3조를 본다."), (2, "no heading. at all\nhere"), (3, ""), (4, None)], "doc_id long, text string")
    docs.createOrReplaceTempView("laws_to_read")
    got = spark.sql("SELECT d.doc_id, c.* FROM laws_to_read d, LATERAL clauses_of(d.text) c").collect()
    want = evidence.clause_table(docs.where("text is not null")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) >= 3
    got = spark.sql("SELECT d.doc_id, c.* FROM laws_to_read d, LATERAL chunks_of(d.text, 5, 'words') c").collect()
    assert sorted(map(str, got)) == sorted(map(str, evidence.chunk_table(docs, 5).collect()))


@pytest.mark.parametrize("call", ["chunks_of('a', 0, 'words')", "chunks_of('a', 5, 'nobody')", "chunks_of(1, 5, 'words')", "clauses_of(17)"])
def test_wrong_arguments_are_refused_when_the_query_is_analysed(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="takes|knows"):
        spark.sql(f"SELECT * FROM {call}")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_spans_meet_once_whatever_the_width(spark, width):
    r = random.Random(width)
    spans = lambda n, most: [(r.choice([1, 1, 1, 2]), a, a + r.choice([0, 1, 3, most])) for a in (r.randrange(60) for _ in range(n))]
    clauses, hits = [(*c, i) for i, c in enumerate(spans(25, 40))], [(*h, i) for i, h in enumerate(spans(40, 25))]
    got = evidence.overlapping(spark.createDataFrame(clauses, "doc_id long, start int, end int, number int"), spark.createDataFrame(hits, "doc_id long, start int, end int, hit int"), width).select("number", "hit").collect()
    want = {(n, h) for d, a, b, n in clauses for e, x, y, h in hits if d == e and a < y and b > x}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


@pytest.mark.parametrize("wanted,repeats", [(0, 1), (7, 1), (50, 1), (200, 3), (10_000, 2)])
def test_balanced_picks_are_those_of_ranking_whole_kinds(spark, wanted, repeats):
    rows = [(i, "a" if i % 2 else "bcd"[i % 3]) for i in range(120)] + [(500, "e")]
    df = spark.createDataFrame(rows, "id long, kind string").withColumn("sha", F.sha1(F.col("id").cast("string")))
    hashes = {r.id: r.sha for r in df.collect()}
    kinds = {k: sorted((hashes[i], i) for i, x in rows if x == k) for _, k in rows}
    shares = curation.quota({k: len(v) for k, v in kinds.items()}, wanted, repeats)
    want = {(i, k, c) for k, v in kinds.items() for place, (_, i) in enumerate(v) for c in range(repeats) if place + c * len(v) < shares[k]}
    out = curation.pick_balanced(df.select("id", "kind"), "kind", "id", wanted, repeats)
    got = [tuple(x) for x in out.select("id", "kind", "cycle").collect()]
    assert len(got) == len(want) and set(got) == want
    if wanted == 50:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "__lead" in plan.split("Window [row_number()")[1]  # only rows of one stretch are ranked


class Reader:
    """Follows one seed's citations through whole documents held in memory."""

    def __init__(self, texts):
        self.units = {d: [u | {"body": t[u["start"] : u["end"]]} for u in fc.clauses(t)] for d, t in texts.items()}

    def by_key(self, doc, key):
        found = [u["number"] for u in self.units.get(doc, []) if u["key"] == key]
        return (found[0], None) if len(found) == 1 else (None, "clause repeated" if found else "clause missing")

    def supports(self, doc, number):
        """Definitions of terms that the clause uses, and scope clauses before it."""
        body = self.units[doc][number]["body"]
        for u in self.units[doc]:
            if u["number"] != number and re.search(evidence.DEFINITION, u["heading"] or ""):
                terms = re.findall(evidence.TERM, u["body"])
                if any(x in body for x in terms) if "정의" in u["heading"] else u["number"] < number:
                    yield u["number"]

    def walk(self, doc, number, budget=5000):
        sources, needed, queue, said, asked, used = {}, {}, [], [], set(), 0

        class Full(Exception):
            pass

        def take(d, k, depth, must=True):
            nonlocal used
            if needed.get((d, k)) or ((d, k) in needed and not must):
                return
            if (d, k) not in needed:
                if len(needed) == 96:
                    raise Full("too many clauses")
                if d not in sources and len(sources) == 16:
                    raise Full("too many sources")
                used_then = used + len(self.units[d][k]["body"]) + (2 if d in sources else 25 if sources else 1)
                if used_then > budget:
                    raise Full("over budget")
                used = used_then
                sources.setdefault(d, len(sources))
            needed[d, k] = must
            queue.append((d, k, depth, must))

        def enter(d, k, depth):
            take(d, k, depth)
            for e in (k - 1, k + 1):
                if 0 <= e < len(self.units[d]) and self.units[d][e]["exception"]:
                    take(d, e, depth)

        try:
            enter(doc, number, 0)
            while queue:
                d, k, depth, must = queue.pop(0)
                if not must:
                    continue
                unit = self.units[d][k]
                for by in self.supports(d, k):
                    take(d, by, depth, False)
                for u in self.units[d]:
                    for key in u["internal"] if u["exception"] and u["number"] != k else ():
                        if key == unit["key"]:
                            take(d, u["number"], depth)
                for key in unit["internal"]:
                    to, why = self.by_key(d, key)
                    said.append(why) if why else take(d, to, depth)
                for cited in unit["external"]:
                    law = int(cited["law"].removeprefix("law ")) if isinstance(cited, dict) else int(cited[0].removeprefix("law "))
                    to, why = (None, "law not resolved") if law not in self.units else self.by_key(law, cited["key"] if isinstance(cited, dict) else cited[1])
                    if depth >= 3:
                        said.append("citation too deep")
                    elif why:
                        said.append(why)
                    else:
                        asked.add(law)
                        if len(asked) > 32:
                            raise Full("too many laws")
                        enter(law, to, depth + 1)
        except Full as e:
            said.append(str(e))
        said = "; ".join(dict.fromkeys(said))
        picked = sorted(needed, key=lambda x: (sources[x[0]], x[1]))
        text = "\n\n".join(self.units[d][k]["body"] for d, k in picked)
        return not said, len(needed), said, hashlib.md5((f"(incomplete) {said}" if said else text).encode()).hexdigest()


def test_citation_walks_agree_with_reading_whole_documents(spark):
    t = Tables(spark, FOLDER)
    ids = [r.doc_id for r in t.documents.select("doc_id").collect()]
    reader = Reader({r.doc_id: r.text for r in laws(t, max(ids) + 1).collect()})
    got = {r.seed: (r.complete, r.n_clauses, r.warnings, r.content) for r in catalog.queries()["citation_walk"](spark, FOLDER).collect()}
    want = {d: reader.walk(d, 4) for d in ids if d % 50 == 0 and len(reader.units[d]) > 4}
    assert got == want and len(want) >= 2
