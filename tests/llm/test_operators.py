"""Every dealt operator against a brute-force version, on rows that hold the awkward cases."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import common, decontaminate, html_text, lines, packing, personal, ppm, quality, queries, simhash, substrings, warc

BASE = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()[:60]
BENCH = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pylist()
LOWER = common.LOWER


def rows() -> list[dict]:
    """Documents with nulls, empties, copies, near copies, repeated rows, ties, a long text and clashing columns."""
    out = [{"doc_id": r["doc_id"], "text": r["text"], "lang": r["lang"], "source": "hot" if i % 3 == 0 else r["source"]} for i, r in enumerate(BASE)]
    passage = " ".join(f"word{i}" for i in range(60))
    extra = [None, "", " \n\t ", "one", "two words", BASE[3]["text"], BASE[3]["text"] + " tail", BASE[4]["text"].replace(" ", "  "), passage, f"before {passage} after", f"{passage}\n{passage}", " ".join(f"long{i % 977}" for i in range(20_000)),
             "x " * 50, f"see {BENCH[0]['text']}", " ".join(BENCH[1]["text"].upper().split()[:8]) + " and so on " * 40, "mail a.b@c.example.com or 1.2.3.4, 300.1.1.1, 4111 1111 1111 1111, +1 (555) 010-9999 x@y.zz@w.vv", "٣٤ <|endoftext|> end"]
    out += [{"doc_id": 1000 + i, "text": t, "lang": None, "source": None if i % 2 else "hot"} for i, t in enumerate(extra)]
    out.append(dict(out[5]))
    out.append({"doc_id": 2000, "text": BASE[6]["text"], "lang": "en", "source": "hot"})
    return [r | {"n_words": 7, "fp": "clash", "n_chars": len(r["text"] or "")} for r in out]


ROWS = rows()
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_words", pa.int64()), ("fp", pa.string()), ("n_chars", pa.int64())])


def write(folder, docs, pages=()):
    for name, table in (
        ("documents", pa.Table.from_pylist(docs, SCHEMA)), ("benchmark", pa.Table.from_pylist([*BENCH[:8], {"item_id": 900, "text": None}, {"item_id": 901, "text": "?!"}, {"item_id": 902, "text": "so on and"}])),
        ("pages", pa.Table.from_pylist(list(pages), pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]))),
        ("embeddings", pa.Table.from_pylist([], pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]))),
    ):
        pq.write_table(table, folder / f"{name}.parquet")
    return str(folder)


PAGES = [{"page_id": i, "url": f"http://h{i}.example.com/", "html": h} for i, h in enumerate(["<p>" + "a" * 200 + "</p>"] * 3 + ["<p>short</p>"] * 2 + [None, "", "<article><p>Hello &amp; all\r\n\r\nof you</p></article>" * 9])] + [
    {"page_id": 1, "url": None, "html": "<p>" + "a" * 200 + "</p>"}, {"page_id": None, "url": "u\r\nv", "html": "<p>" + "b" * 200 + "</p>"}, {"page_id": 50, "url": "u", "html": "<p>" + "b" * 200 + "</p>"},
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write(tmp_path_factory.mktemp("rows"), ROWS, PAGES)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("none"), [])


def by_id(df) -> dict:
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r.asDict())
    assert sum(map(len, out.values())) == len(ROWS)
    return {k: v for k, v in out.items()}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


def test_components_agree_with_union_find(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(-500, 500, (400, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    found = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found.get(x, x) == find(x) for x in list(up))


def test_warc_round_trip(spark, folder):
    got = sorted(map(tuple, warc.op1(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    first = {}
    for p in PAGES:
        h = (p["html"] or "").encode()
        if len(h) >= 100 and p["page_id"] is not None:
            first[h] = min(first.get(h, p["page_id"]), p["page_id"])
    want = []
    for p in PAGES:
        h = (p["html"] or "").encode()
        again = p["page_id"] is not None and h in first and first[h] != p["page_id"]
        want.append((p["page_id"], len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=str)


def test_warc_reads_only_what_is_selected(spark, folder):
    path = common.folder(spark, "warc-test")
    index = warc.write(common.table(spark, folder, "pages"), path)
    back = warc.read(index.where("page_id = 7"), path).collect()
    assert [(r.page_id, bytes(r.payload).decode()) for r in back] == [(7, PAGES[7]["html"])]
    assert list(warc.ranges([("a", 0, 10), ("a", 10, 5), ("a", 10**9, 5), ("b", 15, 5)])) == [("a", 0, 15, [0, 1]), ("a", 10**9, 10**9 + 5, [2]), ("b", 15, 20, [3])]


def test_warc_rejects_a_damaged_payload():
    member = bytearray(warc.record(1, "u", b"payload" * 30, "0" * 64, None))
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(bytes(member))


def repeated(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_quality_measures(spark, folder):
    got = by_id(quality.op2(spark, folder))
    for r in ROWS:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        rep = repeated(words)
        failed = len(words) < 20 or 100 * rep > 30 * len(words)
        for g in got[r["doc_id"]]:
            assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, failed)
            assert not (g["kept"] and failed)


def test_bad_hosts_lose_doubtful_documents_only(spark):
    good = " ".join(f"fine{i}" for i in range(40))
    doubtful = " ".join(f"odd{i} ##" for i in range(40))
    docs = [(i, good if i % 10 == 0 else doubtful, "bad") for i in range(40)] + [(100 + i, doubtful if i == 0 else good, "good") for i in range(40)]
    out = {r.doc_id: r["__kept"] for r in quality.judged(quality.with_measures(spark.createDataFrame(docs, "doc_id long, text string, source string"))).collect()}
    assert all(out[i] == (i % 10 == 0) for i in range(40)) and all(out[100 + i] for i in range(40))


def test_kept_documents_by_brute_force(spark):
    """Hosts of a given corpus, with the prior, the rates and the verdicts worked out in plain numbers."""
    docs = [(r["doc_id"], r["text"] or "", r["source"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    docs += [(10_000 + i, "tail " * 3 + "## " * 40 + t if i % 4 else t, "spam") for i, (_, t, _) in enumerate(docs[:80])]
    docs += [(20_000 + i, t, f"tiny{i}") for i, (_, t, _) in enumerate(docs[80:120])]
    state, hosts = {}, defaultdict(list)
    for d, t, h in docs:
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars, symbols, dup = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
        base = len(words) < 20 or 100 * quality.repeated_words([w.encode() for w in words]) > 30 * len(words)
        soft = (10 * symbols > len(words)) + (10 * dup > 3 * len(lines)) + (chars > 15 * len(words) or chars < 2 * len(words))
        state[d] = base, soft, h
        hosts[h].append(base or soft > 0)
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean = sum(map(sum, hosts.values())) / len(docs)
    between = np.var(rates, ddof=1) - mean * (1 - mean) * np.mean([1 / len(x) for x in hosts.values()])
    weight = min(max(mean * (1 - mean) / between - 1, 1), quality.HEAVIEST) if between > 0 else quality.HEAVIEST
    want = {}
    for d, (base, soft, h) in state.items():
        rate = (sum(hosts[h]) + mean * weight) / (len(hosts[h]) + weight)
        want[d] = not base and (soft == 0 or rate / (1 - rate) * quality.EVIDENCE**soft < 1)
    out = {r.doc_id: r["__kept"] for r in quality.judged(quality.with_measures(spark.createDataFrame(docs, "doc_id long, text string, source string"))).collect()}
    assert out == want
    assert {k for d, k in want.items() if state[d][1] and not state[d][0]} == {False, True}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items):
    words = WORD.findall((text or "").encode().translate(LOWER).decode())
    covered, names = set(), set()
    for item in items:
        own = WORD.findall((item["text"] or "").encode().translate(LOWER).decode())
        for k in range(max(1, len(own) - 12) if own else 0):
            w = own[k : k + 13]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    covered |= set(range(i, i + len(w)))
                    names.add(str(item["item_id"]))
    return words, covered, names


@pytest.mark.parametrize(("most", "together"), [(decontaminate.MAX_WORDS, decontaminate.PASS_BYTES), (40, decontaminate.PASS_BYTES), (40, 300)])
def test_decontamination(spark, folder, most, together):
    """The same hits with one automaton, with several in one pass, and with several passes."""
    items = pq.read_table(f"{folder}/benchmark.parquet").to_pylist()
    out = decontaminate.scanned(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"), max_words=most, pass_bytes=together)
    assert out.columns == [*SCHEMA.names, "__hit"]
    for r in out.collect():
        words, covered, names = hits(r.text, items)
        h = r["__hit"]
        assert (h.n_words, h.n_hit, h["items"], h.contaminated) == (len(words), len(covered), sorted(names), bool(covered) and 20 * len(covered) >= len(words))
        assert sum(len(WORD.findall(r.text[s.start : s.end])) for s in h.spans) == len(covered)


def test_language_model(spark, folder):
    got = by_id(ppm.op4(spark, folder))
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().translate(LOWER).split(), b"\n"]
    counts = Counter(w for r in ROWS if not held(r["doc_id"]) for w in tokens(r["text"]))
    total, distinct = sum(counts.values()), len(counts)
    found = Counter()
    for r in ROWS:
        if not held(r["doc_id"]):
            found.update(ppm.grams([(r["text"] or "").encode()])[0].tolist())
    nodes = defaultdict(Counter)
    for g, k in found.items():
        raw = g.to_bytes(ppm.ORDER + 1, "big")
        for j in range(ppm.ORDER + 1):
            nodes[raw[j:-1]][raw[-1]] += k

    def code(raw):
        out, score = set(), 0.0
        for j in range(ppm.ORDER + 1):
            live = {s: k for s, k in nodes.get(raw[j:-1], {}).items() if s not in out}
            if raw[-1] in live:
                return score + math.log10((2 * live[raw[-1]] - 1) / (2 * sum(live.values())))
            if live:
                score += math.log10(len(live) / (2 * sum(live.values())))
                out |= set(live)
        return score - math.log10(256 - len(out))

    known = {}
    for r in ROWS:
        words = tokens(r["text"])
        raw = ppm.START * ppm.ORDER + (r["text"] or "").encode() + ppm.END
        score = 0.0
        for i in range(len(raw) - ppm.ORDER):
            g = raw[i : i + ppm.ORDER + 1]
            if g not in known:
                known[g] = code(g)
            score += known[g]
        for g in got[r["doc_id"]]:
            assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held(r["doc_id"]), len(words), sum(counts[w] > 0 for w in words), total)
            assert g["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))
            assert g["score"] == pytest.approx(score)


def test_language_model_is_a_distribution():
    m = ppm.Model.of(Counter(ppm.grams([b"abracadabra", b"abba"])[0].tolist()))
    for context in (b"\xfe\xfe\xfe\xfea", b"cadab", b"zzzzz"):
        assert sum(10 ** m.code_length(int.from_bytes(context + bytes([s]), "big")) for s in range(256)) == pytest.approx(1)


def test_language_model_does_not_depend_on_chunks(spark, folder):
    docs = common.table(spark, folder, "documents")
    one, many = ({(r.doc_id, round(r.score, 6), round(r.base_score, 6)) for r in ppm.scored(docs, chunk_bytes=c).collect()} for c in (1 << 30, 5000))
    assert one == many


@pytest.mark.parametrize("fan", [2, 4])
def test_language_model_does_not_depend_on_levels(spark, folder, fan):
    """Chunks whose counts meet in several levels, words and the sums of training tokens included."""
    docs = common.table(spark, folder, "documents")
    assert 4 < ppm.chunked(docs, 20_000).select("chunk").distinct().count()
    flat, deep = (sorted((r.doc_id is not None, r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in ppm.scored(docs, chunk_bytes=20_000, fan=f).collect()) for f in (64, fan))
    assert flat == deep


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data(spark, tmp_path):
    tricky = ["a@b.co_x@y.zz", "1.2.3.4.5.6.7.8", "0001.002.03.4 and 1.2.3.4567890123", "é" * 5 + " m@n.io", "4111-1111-1111-1111 4111111111111112", "+49 30 1234567 +1.....", "@ + . 5", "9" * 30_000, "a" * 30_000 + "@x.yz", "1-" * 9000 + "1"]
    docs = ROWS + [{"doc_id": 5000 + i, "text": t} for i, t in enumerate(tricky)]
    out = personal.op5(spark, write(tmp_path, docs)).collect()
    assert len(out) == len(docs)
    want = {d["doc_id"]: base_spans(d["text"]) for d in docs}
    for r in out:
        spans = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(",")) | {""} - ({""} if spans else set())


def test_patterns_discover_identifiers(spark):
    """A label that stands before addresses alone also gives away an address in another form."""
    docs = [(i, f"filler words here mailto: user{i}@site{i}.example.com more words") for i in range(40)] + [(100, "filler mailto: user77(at)site.example more"), (101, "filler 77xyz99 elsewhere")]
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in personal.found(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[100] == [("email", 15, 37)] and out[101] == []


def test_discovered_identifiers_bring_in_patterns(spark):
    """Seeds give away "contact:", what stands there gives away "or via", and that an identifier like no seed."""
    docs = [(i, f"some text contact: user{i}@site{i}.example.com end of it") for i in range(30)]
    docs += [(100 + i, f"some text contact: handle{i}[at]site or via handle{i}[at]site now") for i in range(12)]
    docs += [(200, "some text or via zz9-hidden now"), (201, "of the year 2031x in rome"), (202, "of the item 77777 in rome")]
    out = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in personal.found(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[105] == [("email", 19, 34), ("email", 42, 57)]
    assert out[200] == [("email", 17, 27)] and out[201] == out[202] == []


def test_line_deduplication(spark, folder):
    got = by_id(lines.op6(spark, folder))
    every, seen = [], set()
    for r in sorted(ROWS, key=lambda r: r["doc_id"]):
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            every += [(r["doc_id"], i, s) for i, x in enumerate((r["text"] or "").split("\n")) if (s := frozenset(x.encode().split()))]
    gone, at = set(), defaultdict(list)
    for k, (d, i, s) in enumerate(every):
        shared = Counter(j for w in s for j in at[w])
        if any(9 * c >= 4 * (len(s) + len(every[j][2])) for j, c in shared.items()):
            gone.add((d, i))
        for w in s:
            at[w].append(k)
    for r in ROWS:
        kept = "\n".join(x for i, x in enumerate((r["text"] or "").split("\n")) if (r["doc_id"], i) not in gone)
        for g in got[r["doc_id"]]:
            assert g["n_removed"] == sum(d == r["doc_id"] for d, _ in gone)
            assert g["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_families_of_similar_lines(spark, monkeypatch):
    """Long posting lists, dealt in blocks, give what all pairs give."""
    monkeypatch.setattr(lines, "BLOCK", 16)
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(w if r.random() > 0.08 else f"x{r.integers(40)}" for w in base)) for i in range(150)]
    out = lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "n_removed").collect()
    sets = [set(t.split()) for _, t in docs]
    want = {i for i, s in enumerate(sets) if any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in sets[:i])}
    assert {x.doc_id for x in out if x["n_removed"]} == want


def test_html_extraction_of_known_layouts():
    sample = [p["html"] for p in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()]
    model = html_text.trained(sample[:30])
    make = html_text.Layouts([x for h in sample[30:] for x in html_text.Tree(h).text if x], seed=11)
    right = 0
    for _ in range(60):
        page = make.page()
        want = "\n".join(x.replace(make.MARK, "") for x in html_text.Tree(page).text if make.MARK in x)
        right += html_text.texts([page.replace(make.MARK, "")], model)[0] == want
    assert right >= 48
    assert html_text.texts(["", "<p>", "<script>x</script>"], model)[0] == ""


def test_no_node_is_kept_below_a_dropped_one():
    tree = html_text.Tree("<div><p>a</p><div><p>b</p></div></div>")
    forest = html_text.Forest([tree])
    for seed in range(20):
        keep = forest.decode(np.random.default_rng(seed).normal(size=len(tree.tag)))
        assert all(keep[p] for p, k in zip(tree.parent, keep, strict=True) if k and p >= 0)


def test_html_extraction_returns_every_page(spark, folder):
    out = html_text.op7(spark, folder).collect()
    assert len(out) == len(PAGES) and all(r.n_chars == len(r.text) for r in out)


def brute_fingerprint(text):
    words = (text or "").encode().translate(LOWER).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, folder):
    got = by_id(simhash.op8(spark, folder))
    docs = [r for r in ROWS if len(r["text"] or "") < 50_000]
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    assert all(g["fingerprint"] == f"{fps[d]:016x}" for d in fps for g in got[d])
    full = {d: int(g[0]["fingerprint"], 16) for d, g in got.items()}
    root = {d: d for d in full}
    for _ in root:
        for a in full:
            root[a] = min(root[b] for b in full if bin(full[a] ^ full[b]).count("1") <= 3)
    assert all(g["component_id"] == root[d] for d in full for g in got[d])


def test_every_three_byte_difference_meets_in_the_index():
    assert len(simhash.FOURS) == 14
    for a in range(8):
        for b in range(a, 8):
            for c in range(b, 8):
                assert any({a, b, c} <= set(s) for s in simhash.FOURS)


def test_near_fingerprints_in_blocks(spark):
    r = np.random.default_rng(1)
    fps = {int(x) for x in r.integers(-(2**62), 2**62, 50)}
    for _ in range(400):
        x = list(fps)[int(r.integers(len(fps)))]
        fps.add(x ^ sum(1 << int(b) for b in r.choice(60, int(r.integers(1, 5)), replace=False)))
    fps = sorted(fps)
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), block=8)
    found = {r.node: r.root for r in common.components(links).collect()}
    root = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for x in fps:
            least = min(root[y] for y in fps if bin((x ^ y) & (2**64 - 1)).count("1") <= 3)
            if least < root[x]:
                root[x], changed = least, True
    assert {x: found.get(x, x) for x in fps} == root


def brute_substrings(docs, width=20):
    seen, out, done = {}, {}, set()
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        gone = set()
        if r["doc_id"] not in done:
            for i in range(len(w) - width + 1):
                if seen.setdefault(tuple(w[i : i + width]), (r["doc_id"], i)) != (r["doc_id"], i):
                    gone |= set(range(i, i + width))
            out[r["doc_id"]] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
        done.add(r["doc_id"])
    return out


def test_substrings(spark, folder):
    got, want = by_id(substrings.op9(spark, folder)), brute_substrings(ROWS)
    assert {d: {(g["n_words"], g["n_removed"], g["kept_sha256"]) for g in gs} for d, gs in got.items()} == {d: {x} for d, x in want.items()}


def test_substrings_over_many_batches_and_hot_passages(spark, monkeypatch):
    """Runs are compacted, hot fingerprints dealt out, and nothing changes."""
    monkeypatch.setattr(substrings, "HOT", 5)
    docs = [r for r in ROWS if len(r["text"] or "") < 50_000]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept_text)).hexdigest()) for r in substrings.deduplicated(df, batches=5, fan_out=1).collect()}
    assert out == brute_substrings(docs)


def test_a_later_job_opens_the_index_and_adds_to_it(spark, tmp_path):
    """A batch a job, the second with hot merges behind it; compacted runs alone are left, and nothing changes."""
    docs = sorted((r for r in ROWS if r["doc_id"] is not None and len(r["text"] or "") < 50_000), key=lambda r: r["doc_id"])
    place, out = f"{tmp_path}/index", {}
    ids = [r["doc_id"] for r in docs]
    cuts = [ids[0] - 1, ids[len(ids) // 3], ids[2 * len(ids) // 3], ids[-1]]
    for job, (low, high) in enumerate(zip(cuts, cuts[1:])):
        session = spark.newSession()
        index = substrings.SubstringIndex.open(session, place) if job else substrings.SubstringIndex(session, place)
        df = session.createDataFrame([(r["doc_id"], r["text"]) for r in docs if low < r["doc_id"] <= high], "doc_id long, text string")
        out |= {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept_text)).hexdigest()) for r in substrings.deduplicated(df, batches=1, index=index).collect()}
    assert out == brute_substrings(docs)
    assert sorted(level for _, level in substrings.SubstringIndex.open(spark, place).runs) == [0, 1]


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.op10(spark, folder).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
        bins[p.sequence_id].append(p)
    times = Counter(r["doc_id"] for r in ROWS)
    for r in ROWS:
        ids = np.array([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[r["doc_id"]], key=lambda p: p.start)[:: times[r["doc_id"]]]
        assert [p.start for p in own] == [sum(p.length for p in own[:i]) for i in range(len(own))] and sum(p.length for p in own) == len(ids)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)
    for ps in bins.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(p.length for p in ps[:i]) for i in range(len(ps))] and sum(p.length for p in ps) <= 2048


def test_first_fit_decreasing_by_tournament():
    sizes = np.random.default_rng(2).integers(1, 2049, 700)
    bins, offset = packing.first_fit_decreasing(sizes)
    room, want = [], {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        k = next((k for k, x in enumerate(room) if x >= sizes[i]), len(room))
        if k == len(room):
            room.append(2048)
        want[i] = (k, 2048 - room[k])
        room[k] -= sizes[i]
    assert {i: (int(bins[i]), int(offset[i])) for i in want} == want


@pytest.mark.parametrize("html", ["<p>a<![foo[bar]]>b</p>", "<![", "<![CDATA[x]]><p>y", "<!", "<!>", "<!->", "<!---><p>z</p>", "<?x", "</>", "</ x><p>q", "&#xZ; &#99999999; &bogus;", "<p a='", "<" * 2000, "<!DOCTYPE [<!ENTITY x>]><p>k"])
def test_malformed_markup_does_not_end_the_job(html):
    html_text.Tree(html)
    assert isinstance(html_text.texts([html], html_text.trained([]))[0], str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "<!", "<![", "]]>", "--", ">", "<p", "</p>", "<b>", "a", " ", "&", "&#", ";", '"', "<table>", "<td>", "<script>", "</", "<!--", "<?", "\x00", "é"]), max_size=40))
def test_any_markup_makes_a_tree(parts):
    tree = html_text.Tree("".join(parts))
    assert all(p < i for i, p in enumerate(tree.parent))


def test_deep_pages_take_time_in_proportion():
    began = time.perf_counter()
    for html in ("<font>" * 100_000 + "x", "<div>" * 20_000 + "x", "<b><p>x" * 50_000):
        html_text.Tree(html)
    assert time.perf_counter() - began < 30


def test_pages_with_extra_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text of an article that goes on for a while.</p></article>", "t", 5, "r")], "page_id long, url string, html string, text string, n_chars long, row string")
    assert html_text.extracted(pages).columns == ["page_id", "url", "text", "n_chars"] and html_text.extracted(pages.limit(0)).count() == 0


def test_main_text_of_given_pages():
    """Against labels from the pages' own article elements: all words of them, and no others."""
    pages = [p["html"] for p in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    found = html_text.texts(pages, html_text.trained(pages[:100]))
    want = [Counter(unescape(re.sub(r"<[^>]*>", " ", re.search(r"(?s)<article>(.*?)</article>", p)[1])).split()) for p in pages]
    got = [Counter(x.split()) for x in found]
    shared = sum(sum((a & b).values()) for a, b in zip(want, got, strict=True))
    assert shared >= 0.99 * sum(c.total() for c in want) and shared >= 0.99 * sum(c.total() for c in got)


def test_rows_that_repeat_an_item_are_one_item(spark):
    items = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delta"), (None, "epsilon zeta"), (None, "eta theta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta and gamma delta"), (2, "epsilon zeta eta theta")], "doc_id long, text string")
    assert {r.doc_id: (r["__hit"]["items"], r["__hit"].n_hit) for r in decontaminate.scanned(docs, items).collect()} == {1: (["1"], 4), 2: ([""], 4)}


def test_archives_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 500)
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 40) for i in range(60)], "page_id long, url string, html string")
    index = warc.write(pages, str(tmp_path / "warc"))
    back = warc.read(index, str(tmp_path / "warc"))
    assert back.rdd.getNumPartitions() > 10 and {(r.page_id, bytes(r.payload)) for r in back.collect()} == {(i, f"<p>{i}</p>".encode() * 40) for i in range(60)}
