"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base entities (e-mail, IP, card, phone) are the seeds.  The one or two words
before a match, those after it, and the words on both sides are its lexical
patterns.  In each round a pattern's confidence for a kind is the weight of the
seeds among the distinct values that it stands beside; a value's score is that
at least one of its patterns is right; values that score well become seeds, and
so bring in patterns of their own in the next round.  Tokens beside a pattern of
high confidence become spans of the pattern's kind.

Places come from cutting each text at its matches: lengths of what lies between
are added up by a window over the matches of one text, so a text with many
matches costs no more than sorting them.  The expressions are written so that
Java's matcher neither recurses nor rescans a run of characters.

Defined cases.  A null or empty text has no spans.  Repeated rows are each
searched; as seeds, equal entities count once for a pattern's support.  Ties
in a pattern's kinds go to the kind listed first.  An empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import stored, table

#: The four base expressions; possessive quantifiers and look-behinds leave the leftmost matches as they are.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)
#: What a text must hold for an expression to be worth trying.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: A token with a digit or a sign or word for "at": what patterns can discover.
TOKEN = r"(?<!\S)\S*?(?:[0-9@]|[\[({]at[\])}])\S*+"
#: Characters beside a match in which its neighbouring words are looked for.
BESIDE = 60
MIN_SEEDS, ROUNDS, MIN_LENGTH = 3, 3, 5
#: Confidence from which a pattern counts in a round, score from which a value becomes a seed, and confidence from which a pattern makes spans.
WORTH, PROMOTED, CONFIDENT = 0.3, 0.6, 0.7


def cut(text: Column, kind: str, pattern: str) -> Column:
    """Array of (match, length of what precedes it, its neighbourhood), or null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.left(p, F.lit(BESIDE)).alias("head"), F.right(p, F.lit(BESIDE)).alias("tail")))
    worth = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    zipped = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("pre"), F.slice(between, F.lit(2), F.size(found)).alias("post"))
    return F.when(worth & text.rlike(pattern), zipped)


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits ends in zero."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    parts = F.forall(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.right(F.regexp_replace(p, "^0+", ""), F.lit(4)).try_cast("int"), F.lit(0)) <= 255)
    return F.when(kind == "ip", parts).when(kind == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(False)).when(kind == "phone", n.between(9, 15)).otherwise(True)


def searched(docs: DataFrame, text: str = "text") -> DataFrame:
    """A stored row per row of ``docs``: ``rid, doc_id`` and the cut of each kind."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return stored(
        docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), *[cut(t, k, p).alias(k) for k, p in BASE.items()], cut(t, "token", TOKEN).alias("token")), "pii-matches"
    )


def placed(rows: DataFrame) -> DataFrame:
    """``rid, kind, m, start, end, left, right`` of every match, valid or not."""
    each = []
    for kind in [*KINDS, "token"]:
        e = rows.where(F.col(kind).isNotNull()).select("rid", F.posexplode(kind).alias("i", "x"))
        each.append(e.select("rid", F.lit(kind).alias("kind"), "i", F.col("x.m").alias("m"), F.col("x.pre.n").alias("n"), F.col("x.pre.tail").alias("tail"), F.col("x.post.head").alias("head")))
    every = reduce(DataFrame.unionByName, each)
    end = F.sum(F.col("n") + F.length("m")).over(W.partitionBy("rid", "kind").orderBy("i"))
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return every.select("rid", "kind", "m", (end - F.length("m")).alias("start"), end.alias("end"), F.slice(F.reverse(words("tail")), 1, 2).alias("left"), F.slice(words("head"), 1, 2).alias("right"))


def trimmed(tokens: DataFrame) -> DataFrame:
    """Tokens without the quotes and stops around them; too short ones go."""
    core = F.regexp_replace("m", r"""^["'(\[{<=:]+""", "")
    lead = F.length("m") - F.length(core)
    inner = F.regexp_replace(core, r"""[.,;:!?"')\]}>]+$""", "")
    return tokens.withColumn("start", F.col("start") + lead).withColumn("end", F.col("start") + F.length(inner)).withColumn("m", inner).where((F.length("m") >= MIN_LENGTH) & (F.col("end") > F.col("start")))


def free(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``tokens`` that overlap none of ``spans``, by one ordered look at each text."""
    both = tokens.withColumn("base", F.lit(False)).unionByName(spans.withColumn("base", F.lit(True)).select("rid", "kind", "m", "start", "end", "left", "right", "base"))
    order = W.partitionBy("rid").orderBy("start", "end")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    seen = both.withColumn("reach", F.coalesce(reach, F.lit(-1))).withColumn("ahead", ahead)
    return seen.where(~F.col("base") & (F.col("reach") <= F.col("start")) & (F.col("ahead").isNull() | (F.col("ahead") >= F.col("end")))).drop("base", "reach", "ahead")


def beside(matches: DataFrame) -> DataFrame:
    """A row per match and lexical pattern ``p``, told by 64 bits of a hash."""
    side = lambda name, words: F.when(F.size(words) == int(name[1]), F.xxhash64(F.lit(name), F.array_join(words, " ")))
    one = lambda c: F.slice(c, 1, 1)
    both = F.when((F.size("left") > 0) & (F.size("right") > 0), F.xxhash64(F.lit("B"), F.col("left")[0], F.col("right")[0]))
    each = F.array(side("L1", one("left")), side("L2", F.col("left")), side("R1", one("right")), side("R2", F.col("right")), both)
    return matches.select("rid", "kind", F.lower("m").alias("value"), "start", "end", F.explode(F.array_compact(each)).alias("p"))


def patterns(seeds: DataFrame, tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``p, kind, confidence`` of the patterns after ``rounds`` of scoring, from the rows beside seeds and beside other tokens."""
    known = stored(seeds.select("p", "kind", "value").distinct(), "pii-seeds")
    links = stored(tokens.select("p", "value").distinct(), "pii-links")
    total = stored(known.select("p", "value").union(links).groupBy("p").agg(F.count("*").alias("n_values")), "pii-totals")
    labelled = known.select("p", "kind", "value", F.lit(1.0).alias("w"))
    for k in range(rounds):
        held = labelled.groupBy("p", "kind").agg(F.count("*").alias("n"), F.sum("w").alias("weight")).where(F.col("n") >= MIN_SEEDS).join(total, "p")
        scored = stored(held.select("p", "kind", (F.col("weight") / (F.col("n_values") + 1)).alias("confidence")).where(F.col("confidence") >= WORTH), "pii-patterns")
        if k + 1 < rounds:
            doubt = F.sum(F.log(1 - F.col("confidence")))  # below one, as the divisor is above the weight
            values = links.join(scored, "p").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("w")).where(F.col("w") >= PROMOTED)
            values = values.groupBy("value").agg(F.max_by(F.struct("kind", "w"), F.struct("w", "kind")).alias("b")).select("value", "b.*")
            labelled = known.select("p", "kind", "value", F.lit(1.0).alias("w")).unionByName(links.join(values, "value").select("p", "kind", "value", "w"))
    return scored


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """``rid, doc_id, base, spans`` of every row; spans are (start, rank of kind, kind, end), in order."""
    rows = searched(docs, text)
    every = stored(placed(rows), "pii-places")
    base = every.where((F.col("kind") != "token") & valid(F.col("kind"), F.col("m")))
    tokens = stored(free(trimmed(every.where("kind = 'token'")), base), "pii-tokens")
    near = beside(tokens)
    sure = patterns(beside(base), near).where(F.col("confidence") >= CONFIDENT)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    new = near.drop("kind").join(sure, "p").groupBy("rid", "start", "end").agg(F.max_by("kind", F.struct("confidence", -rank)).alias("kind"))
    both = base.select("rid", "start", "end", "kind", F.lit(True).alias("is_base")).unionByName(new.withColumn("is_base", F.lit(False)))
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    lists = both.groupBy("rid").agg(F.array_sort(F.collect_list(F.when(F.col("is_base"), span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.select("rid", "doc_id").join(lists, "rid", "left").select("rid", "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
