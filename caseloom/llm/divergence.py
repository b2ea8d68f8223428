"""Source divergence audit: how far the words of a source stand from those of its language's other sources.

Terms are counted by sorting pointers.  A task joins the texts of a slice into
one byte buffer, sets a pointer at every word start, and sorts the pointers by
multikey quicksort: by eight bytes at a time, and on into the next eight only
where a run is still equal.  Equal runs are terms; inside a run the rows' order
gives occurrences by (lang, source) and the number of documents.  A task's
slices are merged before they leave it, so a common word travels once a source
and task.

Spark adds the counts up by (lang, term), keeps terms of enough documents, and
deals them into shards.  A shard compares its terms' shares in every two
sources of the language, block of sources by block, and gives sums for each
pair and the first terms of each source; sums over shards and ranks follow.

All arithmetic is exact: shares are integers, a quotient of more than 64 bits
is divided in three steps of a thousand.

Defined cases.  Null text, lang and source are ''.  A document without words
belongs to its group all the same, and a language without kept terms has pairs
of value 0.  Repeated rows are documents of their own.  Equal values rank by
item in UTF-8 order.  A very long text fills a slice by itself; a word of any
length is a term.  Columns beside lang, source and text are not read.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caseloom.llm.common import LOWER, small_batches, stored, table

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: Bytes of text in one sorted slice, and of counts that a task merges before it sends them.
SLICE, MERGE = 8 << 20, 48 << 20
#: Terms of a shard, and sources of a block: two blocks are compared at once.
SHARD, BLOCK = 4096, 64
#: Words that are equal in so many steps of eight bytes are compared whole.
STEPS = 8

IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
LOWERED = np.frombuffer(LOWER, np.uint8)
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
COUNTS_ARROW = pa.schema([*((x, pa.string()) for x in ("lang", "source", "term")), ("n", pa.int64()), ("docs", pa.int64())])


def eight(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The eight bytes from ``start`` as a big-endian number; bytes from ``end`` on count as 0, which no word holds."""
    key = np.zeros(len(start), np.uint64)
    for i in range(8):
        at = start + i
        inside = at < end
        key = (key << np.uint64(8)) | np.where(inside, buf[np.where(inside, at, 0)], 0).astype(np.uint64)
    return key


def sorted_runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by their bytes, and the number of each one's run of equal words; equal words keep their order.

    Multikey quicksort, all runs of a step at once: a run that is longer than
    one and whose words go on is parted by its next eight bytes.
    """
    key = eight(buf, start, end)
    order = np.argsort(key, kind="stable")
    key = key[order]
    run = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    for step in range(1, STEPS):
        size = np.bincount(run, minlength=1)
        open_ = np.flatnonzero((size[run] > 1) & (end[order] - start[order] > 8 * step))
        if not len(open_):
            return order, run
        # words of an equal run that end here come first: their next key is 0
        member = np.flatnonzero((size[run] > 1) & np.isin(run, np.unique(run[open_])))
        who = order[member]
        key = eight(buf, start[who] + 8 * step, end[who])
        inner = np.lexsort((key, run[member]))
        order[member] = who[inner]
        key, group = key[inner], run[member]
        parts = np.zeros(len(run), np.int64)
        parts[member[1:]] = (group[1:] == group[:-1]) & (key[1:] != key[:-1])
        run = run + np.cumsum(parts)
    size = np.bincount(run, minlength=1)
    member = np.flatnonzero((size[run] > 1) & np.isin(run, np.unique(run[end[order] - start[order] > 8 * STEPS])))
    whole = sorted(((int(run[m]), buf[start[order[m]] : end[order[m]]].tobytes(), int(order[m])) for m in member), key=lambda x: x)
    parts = np.zeros(len(run), np.int64)
    for m, before, now in zip(member[1:], whole, whole[1:], strict=False):
        parts[m] = before[0] == now[0] and before[1] != now[1]
    order[member] = [x[2] for x in whole]
    return order, run + np.cumsum(parts)


def counted(texts: list[bytes], groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Term, group, occurrences and documents, one entry for each term and group of the slice."""
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    buf = LOWERED[joined]
    step = np.diff(np.concatenate(([False], IS_LETTER[buf], [False])).view(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return [], *(np.zeros(0, np.int64),) * 3
    order, run = sorted_runs(buf, start, end)
    doc = np.searchsorted(ends, start, side="right")[order]
    by = np.lexsort((doc, groups[doc], run))  # inside a term: by group, then document
    run, doc, order = run[by], doc[by], order[by]
    group = groups[doc]
    new = np.concatenate(([True], (run[1:] != run[:-1]) | (group[1:] != group[:-1])))
    first = np.flatnonzero(new)
    new_doc = new | np.concatenate(([True], doc[1:] != doc[:-1]))
    n = np.diff(np.append(first, len(run)))
    terms = [buf[start[o] : end[o]].tobytes() for o in order[first]]
    return terms, group[first], n, np.add.reduceat(new_doc.astype(np.int64), first)


def merged(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(COUNTS_ARROW.names)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs`` of every task; rows of several tasks are to be added up."""
    small_batches(docs.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        texts, keys, size = [], [], 0

        def done() -> pa.Table:
            names = sorted(set(keys))
            place = {k: i for i, k in enumerate(names)}
            terms, group, n, d = counted(texts, np.array([place[k] for k in keys], np.int64))
            langs, sources = (pa.array([k[i] for k in names], pa.string()).take(pa.array(group)) if names else pa.array([], pa.string()) for i in (0, 1))
            return pa.Table.from_arrays([langs, sources, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(d)], schema=COUNTS_ARROW)

        for b in batches:
            for la, so, t in zip(*(c.to_pylist() for c in b.columns[:2]), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if texts and size + len(t) > SLICE:
                    yield done()
                    texts, keys, size = [], [], 0
                texts.append(t)
                keys.append((la, so))
                size += len(t) + 1
        if texts:
            yield done()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for t in sliced(batches):
            held.append(t)
            if sum(x.nbytes for x in held) > MERGE:
                held = [merged(held)]
                if held[0].nbytes > MERGE // 2:
                    yield from held.pop().combine_chunks().to_batches(10_000)
        if held:
            yield from merged(held).combine_chunks().to_batches(10_000)

    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text")))).mapInArrow(run, COUNTS)


def share(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / whole) for n <= whole < 9e15, in steps of a thousand that stay within 64 bits."""
    out, rest = n // whole, n % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shard_results(terms: pa.Table, sources: list[str], totals: np.ndarray, n_terms: int, top: int) -> Iterator[tuple]:
    """(part, source, item, value) of one shard: sums for pairs with source < item, and the ``top`` terms of each source.

    ``terms`` has term, n (of the language) and by (source, n); ``totals`` the number of kept words of each source, the language's last.
    """
    whole = totals + 2 * n_terms
    by = terms["by"].combine_chunks()
    row = pc.list_parent_indices(by).to_numpy()
    flat = by.flatten()
    column = pc.index_in(flat.field("source"), pa.array(sources, pa.string())).to_numpy()
    n = flat.field("n").to_numpy()
    if len(terms):
        # the first terms of each source: only terms that occur there
        p, q = share(n + 2, whole[column]), share(terms["n"].to_numpy() + 2, whole[-1])[row]
        more = p > q
        value, r, c = divergence(p, q)[more], row[more], column[more]
        words = [x.encode() for x in terms["term"].to_pylist()]
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((place[r], -value, c))
        first = np.searchsorted(c[order], c[order], side="left")
        for i in order[np.arange(len(order)) - first < top]:
            yield "term", sources[c[i]], words[r[i]].decode(), int(value[i])
    blocks = range(0, len(sources), BLOCK)

    def shares(low: int) -> np.ndarray:
        """Shares of all terms of the shard in a block of sources."""
        held = np.zeros((len(terms), min(BLOCK, len(sources) - low)), np.int64)
        inside = (column >= low) & (column < low + held.shape[1])
        held[row[inside], column[inside] - low] = n[inside]
        return share(held + 2, whole[None, low : low + held.shape[1]])

    for a in blocks:
        left = shares(a)
        for b in blocks[a // BLOCK :]:
            right = left if a == b else shares(b)
            for i in range(left.shape[1]):
                low = i + 1 if a == b else 0
                sums = divergence(left[:, i : i + 1], right[:, low:]).sum(0) if len(terms) else np.zeros(right.shape[1] - low, np.int64)
                for j, value in enumerate(sums.tolist(), low):
                    yield "pair", sources[a + i], sources[b + j], value


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) of ``docs``."""
    spark = docs.sparkSession
    added = term_counts(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = stored(
        added.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= min_docs).select("lang", "term", "n", "by"), "terms"
    )
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    totals = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    # one row per language: its sources and their numbers of kept words; the result has a row for every two sources
    profiles = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("sources"))
    profiles = stored(profiles.join(sizes, "lang", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0))).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n_terms") / shard)).cast("int")), "profiles")
    dealt = kept.join(profiles.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int")).drop("shards")
    told = profiles.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")

    def compare(key: tuple, terms: pa.Table, told: pa.Table) -> pa.Table:
        listed = told["sources"].combine_chunks().flatten()
        sources, total = listed.field("source").to_pylist(), listed.field("total").to_numpy()
        rows = list(shard_results(terms, sources, np.append(total, total.sum()), told["n_terms"][0].as_py(), top))
        part, src, item, value = zip(*rows, strict=True) if rows else ((),) * 4
        arrays = [pa.array([key[0].as_py()] * len(rows), pa.string()), *(pa.array(x, pa.string()) for x in (src, part, item)), pa.array(value, pa.int64())]
        return pa.Table.from_arrays(arrays, names=["lang", "source", "part", "item", "value"])

    found = stored(dealt.groupBy("lang", "shard").cogroup(told.groupBy("lang", "shard")).applyInArrow(compare, "lang string, source string, part string, item string, value bigint"), "shards")
    sums = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "part", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")).select("lang", "x.source", "part", "x.item", "value")
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct id) >= 10),
c as (select w.lang, source, w.term, count(*) as n from w join kept using (lang, term) group by all),
v as (select lang, count(*) as v from kept group by lang),
g as (select d.lang, d.source, any_value(coalesce(v, 0)) as v from d left join v on v.lang = d.lang group by d.lang, d.source),
totals as (select g.lang, g.source, g.v, coalesce(sum(n), 0) + 2 * g.v as whole from g left join c on c.lang = g.lang and c.source = g.source group by g.lang, g.source, g.v),
p as (select t.lang, t.source, kept.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // t.whole::hugeint as p
      from totals t join kept on kept.lang = t.lang left join c on c.lang = t.lang and c.source = t.source and c.term = kept.term),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * count(*) over (partition by lang))::hugeint as q from kept),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
    union all
    select p.lang, p.source, 'term', p.term, (p - q) * (p - q) // (p + q) from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""
