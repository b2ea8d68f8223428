"""Queries that count, rate, rank and combine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.operators import reports, windows
from caseloom.plans.registry import Tables, query

C = F.col
n = lambda c="*": F.count(c)
WORDS = r"[^ \t\n\r\f\x0B]+"


@query("SELECT source, count(*) AS n_rows FROM documents GROUP BY 1")
def counts_per_source(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(n().alias("n_rows"))


@query("SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS large, count(*) AS n_rows FROM events")
def conditional_counts(t: Tables) -> DataFrame:
    return t.events.agg(F.count_if(C("event_type") == "error").alias("errors"), F.count_if(C("value") > 50).alias("large"), n().alias("n_rows"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25)")
def page_with_total(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'F'")
    page = rows.orderBy(C("o_orderdate").desc(), C("o_orderkey").desc()).limit(25).select("o_orderkey", F.lit(1).alias("k"))
    return page.join(rows.agg(n().alias("total")).withColumn("k", F.lit(1)), "k").select("o_orderkey", "total")


@query("SELECT event_type, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) > 80) AS too_long, count(*) AS n_rows FROM events GROUP BY 1")
def json_path_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if(F.get_json_object("props", "$.k").cast("int") > 80).alias("too_long"), n().alias("n_rows"))


@query("SELECT count(DISTINCT l_orderkey) AS documents, count(*) AS chunks FROM lineitem")
def distinct_documents_and_chunks(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_orderkey").alias("documents"), n().alias("chunks"))


@query("SELECT lang, count(*) FILTER (doc_id % 4 = 0) AS saved, count(*) FILTER (doc_id % 4 = 1) AS skipped, count(*) FILTER (doc_id % 4 = 2) AS failed, count(*) FILTER (doc_id % 4 = 3) AS deferred FROM documents GROUP BY 1")
def run_counters(t: Tables) -> DataFrame:
    outcome = F.element_at(F.array(*map(F.lit, ("saved", "skipped", "failed", "deferred"))), (C("doc_id") % 4 + 1).cast("int"))
    names = ["saved", "skipped", "failed", "deferred"]
    return t.documents.select("lang", outcome.alias("outcome")).groupBy("lang").pivot("outcome", names).count().na.fill(0, names)


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N') AS done, count(*) AS total, CASE WHEN count(*) FILTER (l_returnflag <> 'N') = count(*) THEN 100 ELSE least(99, CAST(floor(100 * count(*) FILTER (l_returnflag <> 'N') / count(*)) AS BIGINT)) END AS percent FROM lineitem GROUP BY 1")
def progress_per_parent(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.count_if(C("l_returnflag") != "N").alias("done"), n().alias("total"))
    status = F.when(C("done") == C("total"), "completed").otherwise("running")
    return g.withColumn("percent", reports.percentage(C("done"), C("total"), status))


@query("SELECT user_id, max(value) AS best FROM events GROUP BY 1")
def max_score_per_id(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("value").alias("best"))


@query("SELECT user_id, CASE max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END) WHEN 3 THEN 'direct' WHEN 2 THEN 'similar' ELSE 'irrelevant' END AS relation FROM events WHERE value > 90 GROUP BY 1")
def strongest_relation(t: Tables) -> DataFrame:
    e = C("event_type")
    relation = F.when(e == "purchase", "direct").when(e == "signup", "similar").otherwise("irrelevant")
    strength = F.when(e == "purchase", 3).when(e == "signup", 2).otherwise(1)
    return t.events.where("value > 90").groupBy("user_id").agg(F.max_by(relation, strength).alias("relation"))


@query("SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def per_label_mean_vector(t: Tables) -> DataFrame:
    means = reports.mean_vector(t.embeddings, "label", "embedding", "mean")
    return means.select("label", F.posexplode("mean").alias("pos", "mean")).select("label", C("pos").cast("long").alias("pos"), F.round("mean", 5).alias("mean"))


@query("SELECT user_id, count(*) AS in_flight FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) >= 2")
def in_flight_over_cap(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'view'").groupBy("user_id").agg(n().alias("in_flight")).where("in_flight >= 2")


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 6 > 0)")
def categories_without_link(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey").distinct().join(t.nation.where("n_nationkey % 6 > 0"), C("c_nationkey") == C("n_nationkey"), "left_anti")


@query("SELECT lang, count(*) AS n_rows, round(count(*) FILTER (length(text) > 500) / count(*), 6) AS nonempty_ratio, round(avg(length(text)), 4) AS mean_length, round(least(1.0, 0.55 * count(*) FILTER (length(text) > 500) / count(*) + 0.35 * least(avg(length(text)) / 1600, 1.0) + 0.1), 6) AS score FROM documents GROUP BY 1")
def column_statistics(t: Tables) -> DataFrame:
    full, size = F.count_if(F.length("text") > 500) / n(), F.avg(F.length("text"))
    score = F.least(F.lit(1.0), 0.55 * full + 0.35 * F.least(size / 1600, F.lit(1.0)) + 0.1)
    return t.documents.groupBy("lang").agg(n().alias("n_rows"), F.round(full, 6).alias("nonempty_ratio"), F.round(size, 4).alias("mean_length"), F.round(score, 6).alias("score"))


@query("SELECT md5(text) AS content, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_id_report(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("content")).agg(n().alias("n_rows")).where("n_rows > 1")


PREDICTED = "SELECT l.*, d.lang, CASE WHEN l.doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS predicted, CASE WHEN l.doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS tuned FROM labels l JOIN documents d USING (doc_id)"


def predicted(t: Tables) -> DataFrame:
    """Labels with two stub predictors that are wrong on known ids."""
    flip = lambda k: F.when(C("doc_id") % k == 0, 1 - C("quality")).otherwise(C("quality"))
    return t.labels.withColumn("predicted", flip(5)).withColumn("tuned", flip(9)).join(t.documents.select("doc_id", "lang"), "doc_id")


@query(f"SELECT lang, round(sum(CAST(predicted = quality AS BIGINT)) / count(*), 4) AS accuracy_value, CAST(sum(CAST(predicted = quality AS BIGINT)) AS BIGINT) AS accuracy_hit, count(*) AS accuracy_total FROM ({PREDICTED}) GROUP BY ROLLUP (lang)")
def metrics_overall_and_per_group(t: Tables) -> DataFrame:
    return predicted(t).rollup("lang").agg(*reports.rate(C("predicted") == C("quality"), "accuracy"))


@query(f"SELECT toxic, count(*) FILTER (predicted = quality) AS tool_hit, count(*) FILTER (predicted = quality AND tuned = quality) AS exact_hit, count(*) FILTER (predicted = 0 AND quality = 0) AS fixed_hit, count(*) AS total FROM ({PREDICTED}) GROUP BY 1")
def tool_call_metrics(t: Tables) -> DataFrame:
    right = C("predicted") == C("quality")
    return predicted(t).groupBy("toxic").agg(F.count_if(right).alias("tool_hit"), F.count_if(right & (C("tuned") == C("quality"))).alias("exact_hit"), F.count_if((C("predicted") == 0) & (C("quality") == 0)).alias("fixed_hit"), n().alias("total"))


@query(f"SELECT quality, toxic, count(*) FILTER (predicted = quality) AS hits, count(*) AS total FROM ({PREDICTED}) GROUP BY 1, 2")
def hits_per_kind(t: Tables) -> DataFrame:
    return predicted(t).groupBy("quality", "toxic").agg(F.count_if(C("predicted") == C("quality")).alias("hits"), n().alias("total"))


@query(f"SELECT quality, predicted, count(*) AS n FROM ({PREDICTED}) WHERE quality <> predicted GROUP BY 1, 2")
def confusion_pairs(t: Tables) -> DataFrame:
    return reports.confusion(predicted(t), "quality", "predicted")


@query("SELECT event_type, count(*) FILTER (json_valid(props)) AS valid, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) = CAST(floor(value) AS BIGINT)) AS supported, count(*) FILTER (length(props) > 9) AS cut FROM events GROUP BY 1")
def extraction_metrics(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.count_if(F.try_parse_json("props").isNotNull()).alias("valid"), F.count_if(k == F.floor("value")).alias("supported"), F.count_if(F.length("props") > 9).alias("cut"))


@query(f"WITH p AS ({PREDICTED}) SELECT lang, b.v AS before, a.v AS after, round(100 * (a.v - b.v), 2) AS points FROM (SELECT lang, round(avg(CAST(predicted = quality AS DOUBLE)), 4) AS v FROM p WHERE lang <> 'fr' GROUP BY 1) b FULL JOIN (SELECT lang, round(avg(CAST(tuned = quality AS DOUBLE)), 4) AS v FROM p WHERE lang <> 'de' GROUP BY 1) a USING (lang)")
def before_after_table(t: Tables) -> DataFrame:
    p = predicted(t)
    share = lambda c, skip: p.where(C("lang") != skip).groupBy("lang").agg(F.round(F.avg((C(c) == C("quality")).cast("double")), 4).alias("v"))
    return reports.before_after(share("predicted", "fr"), share("tuned", "de"), ["lang"], "v")


@query(f"SELECT doc_id, concat_ws('; ', CASE WHEN predicted <> quality THEN 'wrong quality' END, CASE WHEN tuned <> quality THEN 'still wrong' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS reasons FROM ({PREDICTED}) WHERE predicted <> quality OR tuned <> quality")
def mistakes_listed(t: Tables) -> DataFrame:
    wrong, still = C("predicted") != C("quality"), C("tuned") != C("quality")
    return predicted(t).where(wrong | still).select("doc_id", reports.joined_reasons((wrong, "wrong quality"), (still, "still wrong"), (C("toxic") == 1, "toxic")).alias("reasons"))


@query("SELECT lang, count(*) FILTER (length(text) <= 2000) AS kept, count(*) FILTER (length(text) > 2000) AS dropped, CAST(max(length(text)) FILTER (length(text) <= 2000) AS BIGINT) AS longest, round(avg(length(text)) FILTER (length(text) <= 2000), 4) AS mean FROM documents GROUP BY 1")
def length_statistics(t: Tables) -> DataFrame:
    size = F.length("text")
    fits = F.when(size <= 2000, size)
    return t.documents.groupBy("lang").agg(n(fits).alias("kept"), F.count_if(size > 2000).alias("dropped"), F.max(fits).cast("long").alias("longest"), F.round(F.avg(fits), 4).alias("mean"))


@query("SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def metric_log_to_wide(t: Tables) -> DataFrame:
    return reports.wide_by(t.events.where(C("event_type").isin("click", "view")), "user_id", "event_type", "value", ["click", "view"])


@query("SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN 'id:' || c_mktsegment ELSE 'title:' || CAST(c_nationkey AS VARCHAR) END AS group_key, count(*) AS n_rows FROM customer GROUP BY 1")
def version_groups(t: Tables) -> DataFrame:
    law = F.nullif(F.when(C("c_mktsegment") != "BUILDING", C("c_mktsegment")).otherwise(""), F.lit(""))
    key = F.when(law.isNotNull(), F.concat(F.lit("id:"), law)).otherwise(F.concat(F.lit("title:"), C("c_nationkey").cast("string")))
    return t.customer.groupBy(key.alias("group_key")).agg(n().alias("n_rows"))


@query(f"SELECT lang, count(*) FILTER (predicted = tuned) AS same_field, count(*) FILTER (predicted = tuned AND doc_id % 2 = 0) AS same_text, count(*) AS total FROM ({PREDICTED}) GROUP BY 1")
def prediction_agreement(t: Tables) -> DataFrame:
    p = predicted(t)
    a, b = p.select("doc_id", "lang", C("predicted").alias("x")), p.select("doc_id", C("tuned").alias("y"))
    same = C("x") == C("y")
    return a.join(b, "doc_id").groupBy("lang").agg(F.count_if(same).alias("same_field"), F.count_if(same & (C("doc_id") % 2 == 0)).alias("same_text"), n().alias("total"))


@query(f"SELECT toxic, round(avg(CAST(predicted = quality AS DOUBLE)), 4) AS accuracy FROM ({PREDICTED}) WHERE doc_id % 10 >= 7 GROUP BY 1")
def test_split_summary(t: Tables) -> DataFrame:
    return predicted(t).where("doc_id % 10 >= 7").groupBy("toxic").agg(F.round(F.avg((C("predicted") == C("quality")).cast("double")), 4).alias("accuracy"))


@query("SELECT role, count(*) FILTER (length(text) >= 600) AS cut_at_limit, count(*) FILTER (length(text) BETWEEN 500 AND 599) AS near_limit, count(*) AS calls FROM conversations GROUP BY 1")
def usage_audit(t: Tables) -> DataFrame:
    size = F.length("text")
    return t.conversations.groupBy("role").agg(F.count_if(size >= 600).alias("cut_at_limit"), F.count_if(size.between(500, 599)).alias("near_limit"), n().alias("calls"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_row_per_key(t: Tables) -> DataFrame:
    return windows.first_per(t.events, ["user_id", "event_type"], [C("ts").desc(), C("event_id").desc()]).select("user_id", "event_type", "event_id")


@query("WITH a AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), c AS (SELECT user_id, count(*) AS total FROM a GROUP BY 1), s AS (SELECT user_id, total, CASE WHEN total + 3 - 12 > 0 THEN greatest(total + 3 - 12, 4) ELSE 0 END AS purge FROM c) SELECT a.user_id, a.event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM a) a JOIN s USING (user_id) WHERE r <= purge")
def retention_purge(t: Tables) -> DataFrame:
    a = t.events.where("event_type = 'error'")
    size = a.groupBy("user_id").agg(n().alias("total")).withColumn("purge", windows.purge_size(C("total"), F.lit(3), 12, 4))
    ranked = a.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(C("ts").desc(), C("event_id").desc())))
    return ranked.join(size, "user_id").where("r <= purge").select("user_id", "event_id")


SCORES = "SELECT lang, doc_id, CAST(len(regexp_extract_all(text, 'tion')) AS DOUBLE) AS dense, CAST(len(regexp_extract_all(text, 'en')) AS DOUBLE) AS lexical FROM documents"


def scored(t: Tables) -> DataFrame:
    hits = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("double")
    return t.documents.select("lang", "doc_id", hits("tion").alias("dense"), hits("en").alias("lexical"))


@query(f"WITH s AS ({SCORES}), d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY dense DESC, doc_id) AS r FROM s QUALIFY r <= 20), x AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY lexical DESC, doc_id) AS r FROM s WHERE lexical > 0 QUALIFY r <= 20) SELECT lang, doc_id, round(sum(1 / (60 + r)), 8) AS fused FROM (SELECT * FROM d UNION ALL SELECT * FROM x) GROUP BY 1, 2")
def rrf_hybrid(t: Tables) -> DataFrame:
    s = scored(t)
    top = lambda df, c: df.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc(c), "doc_id"))).where("r <= 20").select("lang", "doc_id", C(c).alias("score"))
    fused = windows.reciprocal_rank_fusion({"dense": top(s, "dense"), "lexical": top(s.where("lexical > 0"), "lexical")}, "doc_id", "score", ["lang"])
    return fused.withColumn("fused", F.round("fused", 8))


@query(f"WITH s AS ({SCORES}), d AS (SELECT lang, doc_id, dense FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY dense DESC, doc_id) <= 5), x AS (SELECT lang, doc_id, lexical FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY lexical DESC, doc_id) <= 5) SELECT lang, doc_id, dense, lexical FROM d FULL JOIN x USING (lang, doc_id)")
def merged_candidates(t: Tables) -> DataFrame:
    s = scored(t)
    top = lambda c: s.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc(c), "doc_id"))).where("r <= 5").select("lang", "doc_id", c)
    return top("dense").join(top("lexical"), ["lang", "doc_id"], "full")


@query(f"WITH s AS ({SCORES}), p AS (SELECT lang, doc_id, dense, row_number() OVER (PARTITION BY lang, doc_id % 50 ORDER BY dense DESC, doc_id) AS r FROM s) SELECT lang, doc_id, dense FROM p WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY dense DESC, doc_id) <= 3")
def best_chunk_per_parent(t: Tables) -> DataFrame:
    best = windows.first_per(scored(t).withColumn("parent", C("doc_id") % 50), ["lang", "parent"], [C("dense").desc(), C("doc_id")])
    return best.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(C("dense").desc(), "doc_id"))).where("r <= 3").select("lang", "doc_id", "dense")


@query("WITH s AS (SELECT lang, source, doc_id, text, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS same, length(text) AS score FROM documents), q AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, doc_id) AS r FROM s WHERE same = 1) SELECT lang, doc_id, source FROM q QUALIFY row_number() OVER (PARTITION BY lang ORDER BY r > 1, score DESC, doc_id) <= 30")
def diversified_pick(t: Tables) -> DataFrame:
    own = windows.first_per(t.documents.withColumn("score", F.length("text")), ["lang", "text"], [C("doc_id")])
    ranked = own.withColumn("r", F.row_number().over(W.partitionBy("lang", "source").orderBy(C("score").desc(), "doc_id")))
    place = F.row_number().over(W.partitionBy("lang").orderBy(C("r") > 1, C("score").desc(), "doc_id"))
    return ranked.withColumn("place", place).where("place <= 30").select("lang", "doc_id", "source")


@query("SELECT source, doc_id, CAST(used AS BIGINT) AS used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 5000")
def budgeted_prefix(t: Tables) -> DataFrame:
    return windows.budgeted_prefix(t.documents, ["source"], [C("doc_id")], "n_chars", 5000).select("source", "doc_id", "used")


@query("SELECT conv_id, turn, lag(role) OVER w AS previous_role, lead(role) OVER w AS next_role, row_number() OVER w AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_references(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("role").over(w).alias("previous_role"), F.lead("role").over(w).alias("next_role"), F.row_number().over(w).cast("long").alias("place"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, lag(e) OVER w AS p, lead(e) OVER w AS q FROM (SELECT conv_id, turn, regexp_matches(text, 'tion') AS e FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE coalesce(p, false) AND coalesce(q, false)")
def neighbour_exceptions(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    e = t.conversations.select("conv_id", "turn", C("text").rlike("tion").alias("e"))
    return e.select("conv_id", "turn", F.lag("e").over(w).alias("p"), F.lead("e").over(w).alias("q")).where("p and q").select("conv_id", "turn")


@query("SELECT lang, batch, count(*) AS n_rows, min(doc_id) AS first_id FROM (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 100 AS batch FROM documents) GROUP BY 1, 2")
def fixed_size_batches(t: Tables) -> DataFrame:
    return windows.batches(t.documents, [C("doc_id")], 100, ["lang"]).groupBy("lang", "batch").agg(n().alias("n_rows"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, chunk, row_number() OVER (PARTITION BY chunk ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) AS place FROM (SELECT doc_id, n_chars, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % (SELECT 1 + count(*) // 200 FROM documents) AS chunk FROM documents)")
def length_buckets(t: Tables) -> DataFrame:
    """Chunks of some 200 documents, so their number grows with the table."""
    chunks = 1 + t.documents.count() // 200
    return windows.length_buckets(t.documents, C("doc_id").cast("string"), "n_chars", chunks).select("doc_id", "chunk", C("place").cast("long").alias("place"))


@query("WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), e AS (SELECT user_id, event_id, r, value AS a FROM s WHERE r = 1 UNION ALL SELECT s.user_id, s.event_id, s.r, 0.3 * s.value + 0.7 * e.a FROM e JOIN s ON s.user_id = e.user_id AND s.r = e.r + 1) SELECT user_id, event_id, round(a, 6) AS average FROM e")
def ema_series(t: Tables) -> DataFrame:
    return windows.running_average(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value", 0.3).withColumn("average", F.round("average", 6))


@query("SELECT doc_id, CAST(position('tion' IN text) AS BIGINT) AS first_at FROM documents WHERE position('tion' IN text) > 0")
def first_match_per_item(t: Tables) -> DataFrame:
    at = F.instr("text", "tion")
    return t.documents.where(at > 0).select("doc_id", at.cast("long").alias("first_at"))


@query("SELECT conv_id, turn, md5(CASE WHEN turn = 0 THEN left(text, 1000) ELSE left(text, 600) END) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE a = 1 OR b <= 5")
def turn_context_first_last5(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id")
    c = t.conversations.withColumn("a", F.row_number().over(w.orderBy("turn"))).withColumn("b", F.row_number().over(w.orderBy(C("turn").desc())))
    cut = F.when(C("turn") == 0, F.left("text", F.lit(1000))).otherwise(F.left("text", F.lit(600)))
    return c.where("a = 1 or b <= 5").select("conv_id", "turn", F.md5(cut).alias("digest"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey < 300 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 200")
def scoped_page_newest(t: Tables) -> DataFrame:
    limit, offset = max(1, min(100, 500)), max(0, 200)
    return t.orders.where("o_custkey < 300").orderBy(C("o_orderdate").desc(), C("o_orderkey").desc()).offset(offset).limit(limit).select("o_orderkey", "o_orderstatus")


TERMS = ["tion", "heou", "thand", "éau"]


@query("SELECT doc_id, score FROM (SELECT doc_id, " + " + ".join(f"CAST(text ILIKE '%{x}%' OR source ILIKE '%{x}%' AS BIGINT)" for x in TERMS) + " AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 40")
def lexical_topk(t: Tables) -> DataFrame:
    score = sum((C("text").ilike(f"%{x}%") | C("source").ilike(f"%{x}%")).cast("long") for x in TERMS)
    return t.documents.select("doc_id", score.alias("score")).where("score > 0").orderBy(C("score").desc(), "doc_id").limit(40)


@query("SELECT doc_id, sha1('salt' || CAST(doc_id AS VARCHAR)) AS place FROM documents")
def hash_order(t: Tables) -> DataFrame:
    h = F.sha1(F.concat(F.lit("salt"), C("doc_id").cast("string")))
    return t.documents.select("doc_id", h.alias("place")).orderBy("place", "doc_id")


@query("SELECT doc_id, n_chars > 4000 AS is_long FROM documents ORDER BY n_chars > 4000, doc_id")
def queue_order(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (C("n_chars") > 4000).alias("is_long")).orderBy("is_long", "doc_id")


@query(f"SELECT doc_id, lexical FROM ({SCORES}) WHERE lexical >= 60")
def threshold_then_sort(t: Tables) -> DataFrame:
    return scored(t).where("lexical >= 60").select("doc_id", "lexical").orderBy(C("lexical").desc(), "doc_id")


@query(f"SELECT doc_id, CASE WHEN dense >= lexical AND dense >= 3 THEN 'dense' WHEN lexical >= 3 THEN 'lexical' ELSE 'none' END AS best FROM ({SCORES})")
def stable_argmax(t: Tables) -> DataFrame:
    order = ["dense", "lexical", "none"]
    each = F.array(*[F.struct((F.lit(3.0) if k == "none" else C(k)).alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("name")) for i, k in enumerate(order)])
    floor = F.filter(each, lambda s: (s["score"] >= 3) & ((s["name"] != "none") | (F.greatest("dense", "lexical") < 3)))
    return scored(t).select("doc_id", F.array_max(floor)["name"].alias("best"))


@query("SELECT kind, count(*) AS n_rows FROM (SELECT 'short' AS kind, doc_id FROM documents WHERE n_chars < 1000 UNION ALL SELECT 'chunk', conv_id FROM conversations WHERE length(text) > 300) GROUP BY 1")
def union_of_candidates(t: Tables) -> DataFrame:
    short = t.documents.where("n_chars < 1000").select(F.lit("short").alias("kind"), "doc_id")
    chunk = t.conversations.where(F.length("text") > 300).select(F.lit("chunk").alias("kind"), C("conv_id").alias("doc_id"), "turn")
    return short.unionByName(chunk, allowMissingColumns=True).groupBy("kind").agg(n().alias("n_rows"))


@query("SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) = ['F', 'O', 'P'] AS complete, count(*) <> count(DISTINCT o_orderpriority) AS repeats FROM orders GROUP BY 1")
def set_equality(t: Tables) -> DataFrame:
    full = F.array(*map(F.lit, "FOP"))
    return t.orders.groupBy("o_custkey").agg((F.sort_array(F.collect_set("o_orderstatus")) == full).alias("complete"), (n() != F.count_distinct("o_orderpriority")).alias("repeats"))


@query("SELECT user_id, list_sort(list_filter(['click', 'view', 'refund'], lambda x: NOT list_contains(k, x)))[1] AS first_missing, CAST(len(list_filter(k, lambda x: NOT list_contains(['click', 'view', 'refund'], x))) AS BIGINT) AS unknown FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events GROUP BY 1)")
def field_set_difference(t: Tables) -> DataFrame:
    want = F.array(*map(F.lit, ("click", "view", "refund")))
    k = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return k.select("user_id", F.get(F.sort_array(F.array_except(want, "k")), 0).alias("first_missing"), F.size(F.array_except("k", want)).cast("long").alias("unknown"))


@query("SELECT CASE WHEN o_orderdate <= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' THEN 'eligible' ELSE 'excluded' END AS part, count(*) AS n_rows FROM orders GROUP BY 1")
def eligible_and_excluded(t: Tables) -> DataFrame:
    ok = (C("o_orderdate") <= F.lit("1998-01-01").cast("timestamp")) & (C("o_orderstatus") != "P")
    return t.orders.groupBy(F.when(ok, "eligible").otherwise("excluded").alias("part")).agg(n().alias("n_rows"))


@query("SELECT lang, repeat, count(*) AS n_rows FROM (SELECT lang, unnest(range(1, CASE lang WHEN 'en' THEN 2 ELSE 4 END)) AS repeat FROM documents) GROUP BY 1, 2")
def union_with_repeats(t: Tables) -> DataFrame:
    times = F.when(C("lang") == "en", 1).otherwise(3)
    return t.documents.select("lang", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))).alias("repeat")).groupBy("lang", "repeat").agg(n().alias("n_rows"))
