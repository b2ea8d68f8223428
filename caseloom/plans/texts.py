"""Queries on texts, vectors, JSON and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import json_text, text, vectors
from caseloom.operators import rules
from caseloom.plans.registry import Tables, query
from caseloom.sources.scratch import small_batches

C = F.col
n = lambda c="*": F.count(c)
CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({CLEAN}) AS fingerprint, CAST(length({CLEAN}) AS BIGINT) AS n_clean FROM documents")
def clean_and_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.fingerprint(C("text")).alias("fingerprint"), F.length(text.clean(C("text"))).cast("long").alias("n_clean"))


REDACT = rf"regexp_replace(regexp_replace(regexp_replace({CLEAN}, '\b\d{{6}}[- ]?[1-4]\d{{6}}\b', '[개인정보 제외]', 'g'), '\d{{2,3}}[- ]?\d{{3,4}}[- ]?\d{{4}}', '[개인정보 제외]', 'g'), '[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}', '[개인정보 제외]', 'g')"


@query(f"SELECT doc_id, md5({REDACT}) AS digest, CAST(len(regexp_extract_all({REDACT}, '개인정보')) AS BIGINT) AS n_redacted FROM documents")
def redact_pii_counts(t: Tables) -> DataFrame:
    r = text.redact(C("text"))
    return t.documents.select("doc_id", r.alias("r")).select("doc_id", F.md5("r").alias("digest"), F.size(F.regexp_extract_all("r", F.lit("개인정보"), F.lit(0))).cast("long").alias("n_redacted"))


@query(r"SELECT doc_id, md5(list_aggregate(list_transform(list_zip(regexp_split_to_array(text, '\d[\d .-]*\d'), list_transform(regexp_extract_all(text, '\d[\d .-]*\d'), lambda m: regexp_replace(m, '[0-9A-Za-z]', '*', 'g'))), lambda z: z[1] || coalesce(z[2], '')), 'string_agg', '')) AS digest FROM documents")
def mask_inside_matches(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.mask_inside(C("text"), r"\d[\d .-]*\d")).alias("digest"))


@query(r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws, regexp_replace(text, '\s+', '', 'g') AS c FROM documents), p AS (SELECT doc_id, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS place, i, k FROM (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, len(ws) AS k FROM w)), s AS (SELECT doc_id, CAST(sum(place) AS BIGINT) AS total, count(*) AS n_spaces FROM p WHERE i < k GROUP BY 1) SELECT w.doc_id, sha256(c) AS compact, CAST(length(c) AS BIGINT) AS n_compact, coalesce(n_spaces, 0) AS n_spaces, coalesce(total, 0) AS places FROM w LEFT JOIN s USING (doc_id)")
def identity_profile(t: Tables) -> DataFrame:
    small_batches(t.spark)
    i = t.documents.select("doc_id", text.identity(C("text")).alias("i"))
    return i.select("doc_id", C("i.compact").alias("compact"), C("i.length").cast("long").alias("n_compact"), F.size("i.spaces").cast("long").alias("n_spaces"), F.aggregate("i.spaces", F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


@query(r"WITH h AS (SELECT doc_id, list_slice(regexp_split_to_array(text, '[ \n]+'), 1, 6) AS h FROM documents) SELECT doc_id, list_filter(h, lambda x: contains(lower(regexp_replace(x, '[\s_·-]+', '', 'g')), 'the') OR contains(lower(regexp_replace(x, '[\s_·-]+', '', 'g')), 'de'))[1] AS title_column, sha256(array_to_string(list_transform(h, lambda x: lower(regexp_replace(x, '\s+', '', 'g'))), chr(31))) AS signature FROM h")
def header_lookup_and_signature(t: Tables) -> DataFrame:
    h = t.documents.select("doc_id", F.slice(F.split("text", r"[ \n]+"), 1, 6).alias("h"))
    return h.select("doc_id", text.first_header(C("h"), ["The", "d e"]).alias("title_column"), text.signature(C("h")).alias("signature"))


MAPPING = "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'stored' END AS stored, n_nationkey / 25.0 AS given, n_nationkey % 3 > 0 AS ok FROM nation"


@query(f"SELECT n_nationkey, CASE WHEN stored IS NOT NULL THEN 'stored' WHEN ok AND given >= 0.65 THEN 'model' ELSE 'heuristic' END AS chosen FROM ({MAPPING})")
def mapping_choice(t: Tables) -> DataFrame:
    m = t.nation.select("n_nationkey", F.when(C("n_nationkey") % 5 == 0, "stored").alias("stored"), (C("n_nationkey") / 25).alias("given"), (C("n_nationkey") % 3 > 0).alias("ok"))
    return m.select("n_nationkey", F.coalesce("stored", F.when(C("ok") & (C("given") >= 0.65), "model"), F.lit("heuristic")).alias("chosen"))


@query("SELECT c_custkey, nullif(concat_ws(chr(10), nullif(CASE WHEN c_custkey % 3 > 0 THEN c_name END, ''), nullif(CASE WHEN c_custkey % 2 > 0 THEN c_mktsegment END, '')), '') AS content FROM customer")
def row_to_record(t: Tables) -> DataFrame:
    parts = F.array(F.when(C("c_custkey") % 3 > 0, C("c_name")), F.when(C("c_custkey") % 2 > 0, C("c_mktsegment")))
    return t.customer.select("c_custkey", F.nullif(F.array_join(F.filter(parts, lambda p: p != ""), "\n"), F.lit("")).alias("content"))


@query("SELECT conv_id, turn, coalesce(nullif(left(text, 10), ''), 'untitled') AS title, md5(CASE role WHEN 'user' THEN 'Q: ' || text ELSE 'A: ' || text END) AS body, position(chr(0) IN text) > 0 AS rejected FROM conversations")
def reference_record(t: Tables) -> DataFrame:
    body = F.when(C("role") == "user", F.concat(F.lit("Q: "), "text")).otherwise(F.concat(F.lit("A: "), "text"))
    return t.conversations.select("conv_id", "turn", F.coalesce(F.nullif(F.left("text", F.lit(10)), F.lit("")), F.lit("untitled")).alias("title"), F.md5(body).alias("body"), F.contains("text", F.lit("\0")).alias("rejected"))


@query(r"SELECT doc_id, md5(left(trim(regexp_replace(array_to_string(list_slice(regexp_extract_all(text, '[^.!?。]+[.!?。]?'), 1, 3), ' '), '\s+', ' ', 'g')), 700)) AS summary, regexp_matches(text, 'heou|éau') AS urgent, length(text) < 20 AS review FROM documents")
def summary_and_flags(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.summary(C("text"))).alias("summary"), C("text").rlike("heou|éau").alias("urgent"), (F.length("text") < 20).alias("review"))


CATALOGUE = {"alpha": ["tion", "ing"], "beta": ["ationing", "heou"], "gamma": ["thand", "éau", "ou"]}
SPECIFIC = {"beta": ["ationing"], "gamma": ["thand"]}
COUNTS = {c: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws) for c, ws in CATALOGUE.items()}


@query("SELECT doc_id, CASE greatest(a, b, g) WHEN 0 THEN 'other' WHEN a THEN 'alpha' WHEN b THEN 'beta' ELSE 'gamma' END AS category, greatest(a, b, g) AS score, CASE WHEN greatest(a, b, g) >= 3 THEN 0.8::DOUBLE WHEN greatest(a, b, g) > 0 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM (SELECT doc_id, CAST(" + COUNTS["alpha"] + " AS BIGINT) AS a, CAST(" + COUNTS["beta"] + " AS BIGINT) AS b, CAST(" + COUNTS["gamma"] + " AS BIGINT) AS g FROM documents)")
def keyword_scores(t: Tables) -> DataFrame:
    k = rules.keyword_score(C("text"), CATALOGUE, "other")
    return t.documents.select("doc_id", k.alias("k")).select("doc_id", "k.category", C("k.score").cast("long").alias("score"), "k.confidence")


RULES = "WITH k AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i}, '{w}', {3 if w in SPECIFIC.get(c, []) else 1})" for i, (c, ws) in enumerate(CATALOGUE.items()) for w in ws) + ") v(category, place, word, weight)), h AS (SELECT doc_id, category, place, weight, position(m IN lower(text)) AS a, position(m IN lower(text)) + length(m) AS b FROM (SELECT *, regexp_extract(lower(text), array_to_string(regexp_split_to_array(word, ''), '\\s*')) AS m FROM documents, k) WHERE m <> ''), r AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.a <= h.a AND o.b >= h.b AND (o.a < h.a OR o.b > h.b) AND (o.weight > h.weight OR (o.category = h.category AND o.weight >= h.weight)))), s AS (SELECT d.doc_id, c.category, c.place, CAST(coalesce(sum(r.weight), 0) AS BIGINT) AS score FROM documents d CROSS JOIN (SELECT DISTINCT category, place FROM k) c LEFT JOIN r ON r.doc_id = d.doc_id AND r.category = c.category GROUP BY 1, 2, 3), b AS (SELECT doc_id, list(score ORDER BY score DESC, place) AS l, list(category ORDER BY score DESC, place) AS names FROM s GROUP BY 1)"


@query(RULES + " SELECT doc_id, CASE WHEN l[1] > 0 THEN names[1] ELSE 'other' END AS category, l[1] AS top, l[1] - l[2] AS margin, concat_ws(',', CASE WHEN l[1] = 0 THEN 'no_keyword' WHEN l[1] < 3 THEN 'weak_score' END, CASE WHEN l[1] > 0 AND l[1] - l[2] = 0 THEN 'tie' WHEN l[1] > 0 AND l[1] - l[2] < 2 THEN 'small_margin' END) AS reasons FROM b")
def rule_classifier_scores(t: Tables) -> DataFrame:
    low = t.documents.select("doc_id", F.lower("text").alias("low"))
    d = rules.classified(low, "low", CATALOGUE, SPECIFIC, {}, {}, "other", None)
    return d.select("doc_id", "rule.category", C("rule.top").cast("long").alias("top"), C("rule.margin").cast("long").alias("margin"), F.array_join("rule.reasons", ",").alias("reasons"))


SEEN = "substr(low, greatest(a - 25, 0) + 1, n + 24 + least(a - 1, 24))"
LENGTHS = "CAST(coalesce(list_sum(list_transform({}, lambda x: length(x))), 0) AS BIGINT)"
#: The first place of a word that has "the" or "ing" around it, and no "tion".
IN_CONTEXT = rf"SELECT doc_id, category, place, weight, a, a + n AS b FROM (SELECT doc_id, category, place, weight, low, length(found[i + 1]) AS n, 1 + {LENGTHS.format('pieces[1:i + 1]')} + {LENGTHS.format('found[1:i]')} AS a FROM (SELECT *, unnest(range(len(found))) AS i FROM (SELECT doc_id, lower(text) AS low, regexp_split_to_array(lower(text), 'h\s*e\s*o\s*u') AS pieces, regexp_extract_all(lower(text), 'h\s*e\s*o\s*u') AS found FROM documents)), (SELECT category, place, weight FROM k WHERE word = 'heou')) WHERE regexp_matches({SEEN}, 'the|ing') AND NOT regexp_matches({SEEN}, 'tion') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY a) = 1"
RULES_IN_CONTEXT = RULES.replace("WHERE m <> '')", f"WHERE m <> '' AND word <> 'heou' UNION ALL {IN_CONTEXT})")


@query(RULES_IN_CONTEXT + f", d AS (SELECT doc_id, CASE WHEN l[1] > 0 THEN names[1] ELSE 'other' END AS category, l[1] AS top, l[1] > 0 AND (l[1] < 3 OR l[1] - l[2] < 2) AS needs_model, redacted FROM b JOIN (SELECT doc_id, {REDACT} AS redacted FROM documents) USING (doc_id)), o AS (SELECT *, CASE WHEN NOT CASE WHEN trim(redacted) = '' THEN false WHEN needs_model THEN true WHEN length(redacted) < 20 THEN false ELSE top = 0 AND length(redacted) < 80 END THEN 'skipped' WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM d) SELECT doc_id, category AS rule_category, needs_model, CASE outcome WHEN 'ok' THEN 'beta' ELSE category END AS category, CASE outcome WHEN 'ok' THEN 'model' WHEN 'failed' THEN 'rule after failure' ELSE 'rule' END AS evidence FROM o")
def rule_classifier_in_context(t: Tables) -> DataFrame:
    """With allow and deny patterns around an ambiguous word; the gate for a model call and the merged decision."""
    context = {("beta", "heou"): ("the|ing", "tion")}
    d = rules.classified(t.documents.select("doc_id", "text"), "text", CATALOGUE, SPECIFIC, {}, context, "other", None)
    model = F.struct(F.lit("beta").alias("category"), F.lit(0.9).alias("confidence"))
    outcome = F.when(~rules.wants_model(C("rule"), text.redact(C("text")), other="other"), "skipped").when(C("doc_id") % 3 == 0, "failed").otherwise("ok")
    return d.select("doc_id", "rule.category", "rule.needs_model", rules.merged(C("rule"), model, outcome).alias("m")).select("doc_id", C("category").alias("rule_category"), "needs_model", "m.category", "m.evidence")


@query(r"SELECT event_id, CASE WHEN k IN ('1', '2', '3') AND length(event_type) > 4 THEN k ELSE '0' END AS category, k IN ('1', '2', '3') AND length(event_type) > 4 AS by_model FROM (SELECT event_id, event_type, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS k FROM events)")
def validated_model_output(t: Tables) -> DataFrame:
    k = (F.get_json_object("props", "$.k").cast("long") % 5).cast("string")
    output = F.to_json(F.struct(k.alias("category"), F.when(F.length("event_type") > 4, C("event_type")).otherwise(" ").alias("summary"), F.lit("none").alias("urgency")))
    return t.events.select("event_id", rules.validated(output, ["1", "2", "3"], F.lit("0")).alias("v")).select("event_id", "v.category", "v.by_model")


@query("SELECT lang, CAST(floor(q * 20) AS BIGINT) AS bucket, count(*) AS n_rows FROM (SELECT lang, least(1.0, least(length(c) / 160, 1.0) * 0.45 + length(regexp_replace(c, '[^\\p{L}\\p{N}.,!?·()\\[\\]''\"\\-:/]', '', 'g')) / length(c) * 0.35 + 0.20 * (CAST(contains(text, 'tion') AS INT) + CAST(contains(text, 'zzz') AS INT)) / 2) AS q FROM (SELECT lang, text, regexp_replace(text, '\\s+', '', 'g') AS c FROM documents)) GROUP BY 1, 2")
def text_quality_buckets(t: Tables) -> DataFrame:
    q = text.quality(C("text"), ["tion", "zzz"])
    return t.documents.groupBy("lang", F.floor(q * 20).alias("bucket")).agg(n().alias("n_rows"))


@query("SELECT item_id, array_to_string(list_slice(list_distinct_ordered, 1, 20), ' ') AS terms FROM (SELECT item_id, list(w ORDER BY i) AS list_distinct_ordered FROM (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(text, '[가-힣A-Za-z0-9]{2,}') AS ws FROM benchmark)) GROUP BY 1, 2) GROUP BY 1)")
def query_terms(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(text.query_terms(C("text")), " ").alias("terms"))


@query("SELECT doc_id, CAST(CASE WHEN len(p) BETWEEN 2 AND 3 THEN len(p) ELSE 1 END AS BIGINT) AS asked FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[!]+'), lambda x: trim(x)), lambda x: length(x) >= 10) AS p FROM documents)")
def question_split(t: Tables) -> DataFrame:
    asked = F.size(text.questions(F.lit("T"), F.translate("text", "!?", "?")))
    return t.documents.select("doc_id", asked.cast("long").alias("asked"))


@query("SELECT o_orderkey, strftime(try_cast(s AS DATE), '%Y-%m-%d') AS found FROM (SELECT o_orderkey, printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate), (day(o_orderdate) + o_orderkey % 9)) AS s FROM orders)")
def date_from_text(t: Tables) -> DataFrame:
    said = F.format_string("on %d. %d. %d, at noon", F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate") + C("o_orderkey") % 9)
    return t.orders.select("o_orderkey", F.date_format(text.date_in(said), "yyyy-MM-dd").alias("found"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.word_count(C("text")).cast("long").alias("n_words"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(r"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:Version|version|CC BY-NC) (\d+)', 1), lambda x: CAST(x AS BIGINT)))), ','), '') AS ids FROM documents")
def explicit_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.sort_array(text.ids_in(C("text"), [r"Version (\d+)", r"version (\d+)", r"CC BY-NC (\d+)"])).cast("array<string>"), ",").alias("ids"))


@query("SELECT event_id, CASE WHEN k % 4 < 3 AND (k % 4 <> 1 OR known) THEN ['list', 'show', 'help'][k % 4 + 1] END AS intent, CASE WHEN k % 4 = 1 AND known THEN user_id END AS target FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 2 = 0 AS known FROM events)")
def intent_validation(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 4
    said = F.to_json(F.struct(F.element_at(F.array(*map(F.lit, ("list", "show", "help", "drop"))), (k + 1).cast("int")).alias("intent"), C("user_id").alias("target")))
    got = F.from_json(said, "intent string, target long")
    known = got["target"] % 2 == 0
    ok = got["intent"].isin("list", "show", "help") & ((got["intent"] != "show") | known)
    return t.events.select("event_id", F.when(ok, got["intent"]).alias("intent"), F.when(ok & (got["intent"] == "show"), got["target"]).alias("target"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 5 = 0 AS plain FROM events")
def json_recovery(t: Tables) -> DataFrame:
    m = C("event_id") % 5
    said = F.when(m == 0, C("props")).when(m == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))).when(m == 3, F.left("props", F.lit(5))).otherwise("[1, 2]")
    return t.events.select("event_id", F.get_json_object(json_text.object_in(said), "$.k").cast("long").alias("k"), json_text.is_object(said).alias("plain"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'find.' || event_type END AS tool, CASE WHEN event_id % 3 > 0 THEN '{\"k\": ' || json_extract_string(props, '$.k') || ', \"q\": \"a:b, c\"}' END AS arguments, CASE WHEN event_id % 3 > 0 THEN 'ok' ELSE event_type END AS text FROM events")
def tool_call_parse(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    said = F.when(C("event_id") % 3 > 0, F.concat(F.lit("<|channel>hm<channel|> ok <|tool_call>call:find."), "event_type", F.lit('{q:<|"|>a:b, c<|"|>,k:'), k, F.lit("}<tool_call|>"))).otherwise(C("event_type"))
    return t.events.select("event_id", json_text.tool_call(said).alias("c")).select("event_id", "c.*")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\d+(?:[.,]\d+)*')) AS BIGINT) AS n_numbers, coalesce(array_to_string(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), lambda x: CASE WHEN contains(replace(x, ',', ''), '.') THEN coalesce(nullif(ltrim(split_part(replace(x, ',', ''), '.', 1), '0'), ''), '0') || '.' || regexp_replace(replace(x, ',', ''), '^[^.]*\.', '') ELSE coalesce(nullif(ltrim(replace(x, ',', ''), '0'), ''), '0') END), ' '), '') AS numbers FROM documents")
def numbers_in_text(t: Tables) -> DataFrame:
    found = text.numbers_in(C("text"))
    return t.documents.select("doc_id", F.size(found).cast("long").alias("n_numbers"), F.array_join(found, " ").alias("numbers"))


@query(r"WITH x AS (SELECT conv_id, turn, regexp_extract_all(text, '\d+') AS l FROM conversations) SELECT b.conv_id, b.turn, CAST(len(list_filter(list_transform(b.l, lambda y: coalesce(nullif(ltrim(y, '0'), ''), '0')), lambda y: NOT list_contains(list_transform(a.l, lambda z: coalesce(nullif(ltrim(z, '0'), ''), '0')), y))) AS BIGINT) AS missing FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def numbers_missing_from_source(t: Tables) -> DataFrame:
    plain = F.regexp_replace("text", "[.,]", " ")
    a = t.conversations.select("conv_id", (C("turn") + 1).alias("turn"), plain.alias("source"))
    b = t.conversations.select("conv_id", "turn", plain.alias("said"))
    return b.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.size(text.numbers_missing(C("said"), C("source"))).cast("long").alias("missing"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS square, vec_id % 7 > 0 AS usable, CASE WHEN vec_id % 7 = 0 THEN 'dimension 63' END AS warning FROM embeddings")
def vector_check(t: Tables) -> DataFrame:
    v = F.when(C("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(C("embedding"))
    return t.embeddings.select("vec_id", F.round(vectors.dot(C("embedding"), C("embedding")), 4).alias("square"), vectors.usable(v, 64).alias("usable"), vectors.held_back(v, 64).alias("warning"))


@query("SELECT vec_id, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS first FROM embeddings")
def unit_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(vectors.unit(C("embedding"), 64)[0], 6).alias("first"))


FOLD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 41), lambda i: CAST(CASE WHEN substr(h, i, 1) >= 'a' THEN ascii(substr(h, i, 1)) - 87 ELSE ascii(substr(h, i, 1)) - 48 END AS BIGINT))), lambda a, x: (a * 16 + x) % 10000)"


@query(f"SELECT doc_id, b AS bucket, CASE WHEN doc_id % 50 = 0 THEN 'test' WHEN b < 7000 THEN 'train' WHEN b < 8500 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {FOLD} AS b FROM (SELECT doc_id, sha1('g' || CAST(doc_id AS VARCHAR)) AS h FROM documents))")
def split_70_15_15(t: Tables) -> DataFrame:
    group = F.concat(F.lit("g"), C("doc_id").cast("string"))
    return t.documents.select("doc_id", text.bucket(group).alias("bucket"), text.split_of(group, F.when(C("doc_id") % 50 == 0, "test")).alias("split"))


@query("SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'insert' WHEN toxic = 1 THEN 'select' ELSE '?' END AS kind, count(*) AS n_rows FROM labels GROUP BY 1")
def answer_kind(t: Tables) -> DataFrame:
    q, x = C("quality") == 1, C("toxic") == 1
    return t.labels.groupBy(F.when(q & x, "reject").when(q, "insert").when(x, "select").otherwise("?").alias("kind")).agg(n().alias("n_rows"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 1500 THEN left(text, 1500) || '…' ELSE text END) AS digest FROM documents")
def truncated_with_mark(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.truncated(C("text"))).alias("digest"))


@query("SELECT doc_id, md5('[categories] alpha, beta' || chr(10) || '[title] ' || source || chr(10) || '[text] ' || text) AS prompt FROM documents")
def prompt_rendering(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.format_string("[categories] %s\n[title] %s\n[text] %s", F.lit("alpha, beta"), "source", "text")).alias("prompt"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events")
def timestamp_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"))


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 9 END AS code, count(*) AS n_rows FROM orders GROUP BY 1")
def category_remap(t: Tables) -> DataFrame:
    codes = {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": 2}
    lookup = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return t.orders.groupBy(F.coalesce(F.try_element_at(lookup, C("o_orderpriority")), F.lit(9)).alias("code")).agg(n().alias("n_rows"))


@query("SELECT conv_id, md5('[source ' || CAST(conv_id AS VARCHAR) || ']' || chr(10) || string_agg('(' || role || ') ' || text, chr(10) ORDER BY turn) || CASE WHEN count(*) > 5 THEN chr(10) || '(incomplete)' ELSE '' END) AS rendered FROM conversations GROUP BY 1")
def evidence_rendering(t: Tables) -> DataFrame:
    block = F.concat(F.lit("("), "role", F.lit(") "), "text")
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs"))
    notice = F.when(F.size("bs") > 5, "\n(incomplete)").otherwise("")
    return g.select("conv_id", F.md5(F.concat(F.lit("[source "), C("conv_id").cast("string"), F.lit("]\n"), F.array_join("bs.b", "\n"), notice)).alias("rendered"))


@query("SELECT doc_id, '{\"source\":\"' || source || '\",\"lang\":\"' || lang || '\",\"n\":' || CAST(n_chars AS VARCHAR) || '}' AS details FROM documents")
def details_as_json(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.to_json(F.struct("source", "lang", C("n_chars").alias("n"))).alias("details"))


@query("SELECT user_id, greatest(0, count(*) - 70) AS remaining, count(*) >= 60 AS completed FROM events GROUP BY 1")
def counter_arithmetic(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(n().alias("k"))
    return g.select("user_id", F.greatest(F.lit(0), C("k") - 70).alias("remaining"), (C("k") >= 60).alias("completed"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def tool_result_parse(t: Tables) -> DataFrame:
    m = C("event_id") % 3
    said = F.when(m == 0, C("props")).when(m == 1, F.regexp_replace("props", '"', "'")).otherwise("no data")
    return t.events.select("event_id", F.get_json_object(json_text.tool_result(said), "$.k").cast("long").alias("k"))
