"""Queries on duplicates and training records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text
from caseloom.operators import curation, dedup
from caseloom.plans.registry import Tables, query
from caseloom.sources.scratch import small_batches

C = F.col
n = lambda c="*": F.count(c)


@query("SELECT min(doc_id) AS first_id, count(*) AS n_rows FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicate_groups(t: Tables) -> DataFrame:
    g = t.documents.groupBy(F.sha2("text", 256), "text").agg(F.min("doc_id").alias("first_id"), n().alias("n_rows"))
    return g.where("n_rows > 1").select("first_id", "n_rows")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def content_dedup_first(t: Tables) -> DataFrame:
    return dedup.first_of_each(t.documents.select("doc_id", "text"), ["text"], "doc_id").select("doc_id")


def spaced(t: Tables) -> DataFrame:
    """Documents and, beside each, itself with other white space."""
    small_batches(t.spark)
    d = t.documents.select("doc_id", "lang", "text")
    other = F.when(C("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit(" "))).when(C("doc_id") % 3 == 1, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.replace("text", F.lit(" "), F.lit("")))
    both = d.withColumn("copy", F.lit(0)).union(d.withColumn("text", other).withColumn("copy", F.lit(1)))
    return both.withColumn("id", 2 * C("doc_id") + C("copy")).withColumn("profile", text.identity(C("text"), F.lit(True)))


@query(r"WITH s AS (SELECT 2 * doc_id AS id, lang, regexp_replace(trim(text), '\s+', ' ', 'g') AS c FROM documents UNION ALL SELECT 2 * doc_id + 1, lang, regexp_replace(trim(CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), ' ') WHEN 1 THEN replace(text, ' ', '  ') ELSE replace(text, ' ', '') END), '\s+', ' ', 'g') FROM documents) SELECT b.id, min(a.id) AS duplicate_of FROM s a JOIN s b ON a.lang = b.lang AND a.c = b.c AND a.id < b.id GROUP BY 1")
def whitespace_duplicates(t: Tables) -> DataFrame:
    plain = spaced(t).withColumn("profile", text.identity(C("text")))
    return dedup.first_equivalent(plain, "id", "profile", "lang")


SPACED = r"s AS (SELECT 2 * doc_id AS id, lang, text FROM documents UNION ALL SELECT 2 * doc_id + 1, lang, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), ' ') WHEN 1 THEN replace(text, ' ', '  ') ELSE replace(text, ' ', '') END FROM documents), c AS (SELECT id, lang, regexp_replace(text, '\s+', '', 'g') AS compact, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM s), u AS (SELECT id, unnest(range(len(ws))) AS i, unnest(ws) AS word, unnest(gaps) AS gap FROM (SELECT id, regexp_split_to_array(t, '\s+') AS ws, regexp_extract_all(t, '\s+') AS gaps FROM c)), p AS (SELECT id, sum(length(word)) OVER (PARTITION BY id ORDER BY i) AS at_char, regexp_full_match(gap, '[ \t]*\r?\n[ \t]*') AS wrap FROM u WHERE gap IS NOT NULL)"


@query(f"WITH {SPACED}, pairs AS (SELECT a.id AS earlier, b.id AS later FROM c a JOIN c b ON a.lang IS NOT DISTINCT FROM b.lang AND a.compact = b.compact AND a.id < b.id), sides AS (SELECT earlier, later, earlier AS x, later AS y FROM pairs UNION ALL SELECT earlier, later, later, earlier FROM pairs), bad AS (SELECT DISTINCT earlier, later FROM sides JOIN p ON p.id = x AND NOT wrap WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.id = y AND o.at_char = p.at_char)) SELECT earlier, later FROM pairs ANTI JOIN bad USING (earlier, later)")
def whitespace_equivalent_pairs(t: Tables) -> DataFrame:
    """Pairs equal but for blanks, line wraps of native pages counting as none."""
    return dedup.equivalent_pairs(spaced(t), "id", "profile", "lang")


@query(r"SELECT CAST(count(*) AS BIGINT) AS kept FROM (SELECT DISTINCT lang, regexp_replace(trim(x), '\s+', ' ', 'g') FROM (SELECT lang, text AS x FROM documents UNION ALL SELECT lang, CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), ' ') WHEN 1 THEN replace(text, ' ', '  ') ELSE replace(text, ' ', '') END FROM documents))")
def batch_dedup_count(t: Tables) -> DataFrame:
    plain = spaced(t).withColumn("profile", text.identity(C("text"))).select("id", "lang", "profile")
    return dedup.batch_dedup(plain, "id", "profile", "lang").agg(n().alias("kept"))


@query("SELECT doc_id, CASE WHEN contains(text, '[개인정보 제외]') OR text = '' THEN 'unusable' WHEN first_id < doc_id THEN 'duplicate' ELSE 'profiled' END AS state FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents)")
def legacy_backfill(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text")
    first = d.groupBy("text").agg(F.min("doc_id").alias("first_id"))
    bad = F.contains("text", F.lit(text.REDACTED)) | (C("text") == "")
    return d.join(first, "text").select("doc_id", F.when(bad, "unusable").when(C("first_id") < C("doc_id"), "duplicate").otherwise("profiled").alias("state"))


@query(r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY regexp_replace(regexp_replace(trim(text), '^(The|En|La) ', ''), ' [a-z]+\.$', '')")
def greeting_variants_removed(t: Tables) -> DataFrame:
    bare = dedup.without_greetings("text", "^(The|En|La) ", r" [a-z]+\.$")
    return t.documents.groupBy(bare).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


NEAR = r"""
WITH g AS (SELECT doc_id AS k, list_sort(list_distinct(list_transform(range(1, greatest(length(c) - 2, 1) + 1), lambda i: substr(c, i, 3)))) AS g
           FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)),
     h AS (SELECT k, g, len(g) AS m, min(k) OVER (PARTITION BY g) AS head FROM g),
     e AS (SELECT k, m, unnest(g) AS x FROM h WHERE k = head),
     p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared, any_value(a.m + b.m) AS s FROM e a JOIN e b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2)
SELECT a, b, shared, s - shared AS either FROM p WHERE shared * 100 >= (s - shared) * 72
UNION ALL SELECT head, k, CAST(m AS BIGINT), CAST(m AS BIGINT) FROM h WHERE k <> head"""


@query(NEAR)
def near_duplicate_pairs(t: Tables) -> DataFrame:
    """Documents whose whole texts share 72 of a hundred character grams, a class of equal sets by its first document."""
    return dedup.near_pairs(t.documents, "doc_id", "text", 72, 100)


@query("WITH g AS (SELECT doc_id AS k, list_distinct(string_split(lower(x), ' ')) AS g FROM (SELECT CASE WHEN i <= 1000 THEN doc_id * 1000 + i ELSE -((doc_id << 31) + i) END AS doc_id, x FROM (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))), h AS (SELECT item_id AS k, list_distinct(string_split(lower(text), ' ')) AS g FROM benchmark), p AS (SELECT a.k AS line_id, b.k AS item_id, count(*) AS shared, any_value(a.m + b.m) AS s FROM (SELECT k, len(g) AS m, unnest(g) AS x FROM g) a JOIN (SELECT k, len(g) AS m, unnest(g) AS x FROM h) b USING (x) GROUP BY 1, 2) SELECT line_id, item_id, shared, s - shared AS either FROM p WHERE shared * 2 >= (s - shared) * 1 AND shared * 10 >= (s - shared) * 5")
def benchmark_leakage(t: Tables) -> DataFrame:
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    line = C("i").cast("long") + 1
    # Lines past the 1,000th have negative ids of their own, as theirs would be those of the next document.
    line_id = F.when(line <= 1000, C("doc_id") * 1000 + line).otherwise(-(F.shiftleft(C("doc_id"), 31) + line))
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).select(line_id.alias("line_id"), words("x").alias("g"))
    return dedup.similar(lines, t.benchmark.select("item_id", words("text").alias("g")), "line_id", "item_id", "g", 1, 2)


@query("SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) <= 2")
def two_per_group(t: Tables) -> DataFrame:
    return curation.capped_per_group(t.documents, ["source", "lang"], [C("n_chars").desc(), C("doc_id")], 2).select("source", "lang", "doc_id")


@query("SELECT item_id, array_to_string(list(w ORDER BY i), ' ') AS distinct_words FROM (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)) GROUP BY 1, 2) GROUP BY 1")
def order_preserving_distinct(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("distinct_words"))


def chats(t: Tables) -> DataFrame:
    """User turns as chat records, some of which break a rule."""
    k = (C("conv_id") + C("turn")) % 7
    tool = F.when(k < 3, "insertRequestT").when(k < 5, "selectComplaintT").when(k == 5, "dropT")
    args = F.when(k == 0, F.create_map(F.lit("title"), F.left("text", F.lit(5)), F.lit("content"), C("text"))).when(k == 1, F.create_map(F.lit("title"), F.lit("t"), F.lit("content"), F.upper("text")))
    args = args.when(k == 2, F.create_map(F.lit("content"), C("text"))).when(k == 3, F.create_map(F.lit("content"), F.left("text", F.lit(9)))).when(k == 4, F.create_map(F.lit("content"), F.lit("#none#")))
    kind = F.when((k == 6) & (C("conv_id") % 2 == 0), "reject").when(k == 3, F.lit("reject"))
    return t.conversations.where("role = 'user'").select((C("conv_id") * 100 + C("turn")).alias("id"), "text", tool.alias("tool"), args.alias("arguments"), kind.alias("reply_kind"), k.alias("k"))


CHATS = "SELECT conv_id * 100 + turn AS id, conv_id, text, (conv_id + turn) % 7 AS k FROM conversations WHERE role = 'user'"


@query(f"SELECT id, 'not_verbatim' AS rule FROM ({CHATS}) WHERE k = 1 AND upper(text) <> text UNION ALL SELECT id, 'insert_arguments' FROM ({CHATS}) WHERE k = 2 UNION ALL SELECT id, 'reply_kind_with_tool' FROM ({CHATS}) WHERE k = 3 UNION ALL SELECT id, 'not_in_text' FROM ({CHATS}) WHERE k = 4 UNION ALL SELECT id, 'unknown_tool' FROM ({CHATS}) WHERE k = 5 UNION ALL SELECT id, 'reply_kind' FROM ({CHATS}) WHERE k = 6 AND conv_id % 2 = 1")
def chat_record_rules(t: Tables) -> DataFrame:
    return curation.violations(chats(t), "id", curation.chat_rules())


def analyses(t: Tables) -> DataFrame:
    k = C("doc_id") % 6
    words = F.split("text", r"\s+", 2)
    out = F.struct(
        F.when(k == 0, F.left("text", F.lit(25))).otherwise(F.left("text", F.lit(15))).alias("title"), F.when(k == 1, "about 987654321 things").otherwise(F.left("text", F.lit(40))).alias("summary"),
        F.when(k == 2, F.array(F.lit(" "))).otherwise(F.array(F.lit("point"))).alias("key_points"), F.when(k == 3, "none").otherwise(C("lang")).alias("category"),
        F.when(k == 4, F.array(F.lit("#absent#"))).otherwise(F.slice(words, 1, 1)).alias("keywords"), F.when(k == 5, "soon").otherwise("high").alias("urgency"), (C("doc_id") % 4 == 0).alias("needs_review"), F.when(C("doc_id") % 8 == 0, "why").alias("review_reason"),
    )
    return t.documents.select("doc_id", C("source").alias("title"), C("text").alias("content"), out.alias("output"))


def numbers_sql(said: str) -> str:
    """The numbers of a text without thousands commas and leading zeros."""
    bare, whole = "replace(x, ',', '')", "coalesce(nullif(ltrim({}, '0'), ''), '0')"
    return rf"list_transform(regexp_extract_all({said}, '\d+(?:[.,]\d+)*'), lambda x: CASE WHEN contains({bare}, '.') THEN {whole.format(f"split_part({bare}, '.', 1)")} || '.' || regexp_replace({bare}, '^[^.]*\.', '') ELSE {whole.format(bare)} END)"


#: The records of ``analyses``; ``said`` and ``given`` are the numbers of the summary and of what it sums up.
ANALYSES = rf"a AS (SELECT *, doc_id % 6 AS k, left(text, CASE WHEN doc_id % 6 = 0 THEN 25 ELSE 15 END) AS head, CASE WHEN doc_id % 6 = 1 THEN 'about 987654321 things' ELSE left(text, 40) END AS summary, CASE WHEN length(text) > 1500 THEN left(text, 1500) || '…' ELSE text END AS seen, CASE WHEN doc_id % 6 = 4 THEN '#absent#' ELSE regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')[1] END AS keyword FROM documents), r AS (SELECT *, {numbers_sql("coalesce(summary, '')")} AS said, {numbers_sql("concat_ws(' ', source, seen)")} AS given FROM a)"


@query(f"WITH {ANALYSES} SELECT doc_id, rule FROM (SELECT doc_id, unnest(['C2', 'C3', 'C4', 'C5', 'C6', 'C7', 'C8']) AS rule, unnest([length(trim(head)) NOT BETWEEN 1 AND 20, length(trim(summary)) = 0 OR len(list_filter(said, lambda y: NOT list_contains(given, y))) > 0, k = 2, k = 3 OR lang NOT IN ('en', 'de', 'es', 'fr'), NOT contains(seen, keyword), k = 5, doc_id % 8 = 4]) AS bad FROM r) WHERE bad")
def analysis_record_rules(t: Tables) -> DataFrame:
    return curation.violations(analyses(t), "doc_id", curation.analysis_rules(["en", "de", "es", "fr"]))


@query("SELECT 'repeated id' AS problem, count(*) AS n_rows FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown split', count(*) FROM documents WHERE lang NOT IN ('en', 'de', 'fr')")
def record_file_validation(t: Tables) -> DataFrame:
    twice = t.conversations.groupBy("conv_id").count().where("count > 1").agg(n().alias("n_rows")).select(F.lit("repeated id").alias("problem"), "n_rows")
    return twice.union(t.documents.where(~C("lang").isin("en", "de", "fr")).agg(n().alias("n_rows")).select(F.lit("unknown split"), "n_rows"))


def shares_sql(wanted: int, most_repeats: int = 1) -> str:
    """Water filling: ``q`` holds each language's size and share of ``wanted`` rows."""
    enough = f"least({wanted}, (SELECT sum(room) FROM z))"
    return f"WITH z AS (SELECT lang, count(*) AS n, {most_repeats} * count(*) AS room FROM documents GROUP BY 1), l AS (SELECT max(v) AS level FROM range(0, {wanted + 1}) r(v) WHERE (SELECT sum(least(room, v)) FROM z) <= {enough} AND v <= (SELECT max(room) FROM z)), b AS (SELECT lang, n, least(room, level) AS base, room > level AS open, row_number() OVER (PARTITION BY room > level ORDER BY lang) AS place FROM z, l), q AS (SELECT lang, n, base + CAST(open AND place <= {enough} - (SELECT sum(base) FROM b) AS INT) AS share FROM b)"


@query(shares_sql(500) + " SELECT lang, count(*) AS picked FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR))) AS r FROM documents) JOIN q USING (lang) WHERE r <= share GROUP BY 1")
def balanced_pick(t: Tables) -> DataFrame:
    """500 documents, evenly by language; small languages give all they have."""
    return curation.pick_balanced(t.documents.select("doc_id", "lang"), "lang", "doc_id", 500).groupBy("lang").agg(n().alias("picked"))


@query(shares_sql(1200, 3) + " SELECT lang, doc_id, c AS cycle, sha1(concat(c, '|', doc_id)) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents) JOIN q USING (lang), range(0, 3) t(c) WHERE r + c * n < share")
def balanced_pick_with_repeats(t: Tables) -> DataFrame:
    return curation.pick_balanced(t.documents.select("doc_id", "lang"), "lang", "doc_id", 1200, 3).select("lang", "doc_id", "cycle", "place")


@query("SELECT id, CAST(CASE WHEN k < 6 THEN 5 ELSE 3 END AS BIGINT) AS messages, md5(CASE WHEN k < 6 THEN 'system,user,assistant,tool,assistant' ELSE 'system,user,assistant' END) AS roles FROM (" + CHATS + ")")
def conversation_building(t: Tables) -> DataFrame:
    m = curation.conversation("be brief", C("text"), C("tool"), F.lit("done"), F.lit("ok"))
    return chats(t).select("id", m.alias("m")).select("id", F.size("m").cast("long").alias("messages"), F.md5(F.array_join("m.role", ",")).alias("roles"))


@query(r"SELECT role, count(*) FILTER (len(regexp_extract_all(text, '\S+')) <= 100) AS kept, count(*) FILTER (len(regexp_extract_all(text, '\S+')) > 100) AS dropped FROM conversations GROUP BY 1")
def length_cap(t: Tables) -> DataFrame:
    size = text.word_count(C("text"))
    return t.conversations.groupBy("role").agg(F.count_if(size <= 100).alias("kept"), F.count_if(size > 100).alias("dropped"))


@query(r"SELECT conv_id, turn, CAST(turn + 2 AS BIGINT) AS masked, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS labelled FROM conversations")
def label_mask(t: Tables) -> DataFrame:
    ids = F.transform(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), lambda w: F.length(w))
    m = t.conversations.select("conv_id", "turn", curation.label_mask((C("turn") + 2).cast("int"), ids).alias("m"))
    return m.select("conv_id", "turn", F.size(F.filter("m", lambda x: x == -100)).cast("long").alias("masked"), F.size(F.filter("m", lambda x: x > 0)).cast("long").alias("labelled"))


@query("SELECT CASE role WHEN 'user' THEN 'insert' WHEN 'assistant' THEN 'reply' ELSE '?' END AS intent, count(*) AS n_rows FROM conversations GROUP BY 1")
def source_conversion(t: Tables) -> DataFrame:
    intents = F.create_map(F.lit("user"), F.lit("insert"), F.lit("assistant"), F.lit("reply"))
    return t.conversations.groupBy(F.coalesce(F.try_element_at(intents, C("role")), F.lit("?")).alias("intent")).agg(n().alias("n_rows"))


@query("SELECT CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbols' WHEN regexp_matches(text, '!!') THEN 'shouting' END AS noise, count(*) AS n_rows FROM documents WHERE regexp_matches(text, '[#$%&*]{3}') OR regexp_matches(text, '!!') GROUP BY 1")
def noise_rows(t: Tables) -> DataFrame:
    noise = F.when(C("text").rlike("[#$%&*]{3}"), "symbols").when(C("text").rlike("!!"), "shouting")
    return t.documents.select(noise.alias("noise")).where("noise is not null").groupBy("noise").agg(n().alias("n_rows"))
