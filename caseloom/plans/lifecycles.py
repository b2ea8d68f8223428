"""Queries on files, sinks, state and incremental loads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.operators import lifecycle
from caseloom.plans.registry import SQL, Tables, query
from caseloom.sources import files
from caseloom.sources.scratch import folder, stored
from caseloom.streaming import loads, state

C = F.col
n = lambda c="*": F.count(c)


def csv_of(t: Tables, rows: DataFrame, *by: str) -> tuple[str, str]:
    """A folder of CSV files made from rows by Spark, and the word for null in them, which no text has: an empty text is none."""
    path, null = folder(t.spark, "csv"), uuid.uuid4().hex
    files.write_csv(rows, path, null, by)
    return path, null


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def csv_record_scan(t: Tables) -> DataFrame:
    """Texts with quotes and line breaks, written as CSV and read back."""
    path, null = csv_of(t, t.documents.select(C("doc_id").cast("string").alias("doc_id"), "text"))
    return files.read_csv(t.spark, path, ["doc_id", "text"], null=null).select(C("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16-le' ELSE 'cp949' END AS encoding FROM documents")
def csv_encoding_sniff(t: Tables) -> DataFrame:
    """Texts in UTF-8 with and without a mark, in UTF-16, and after two Hangul syllables in cp949."""
    body = F.encode("text", "UTF-8")
    k = C("doc_id") % 4
    content = F.when(k == 0, body).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), body)).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("C7D1B1DB")), body))
    return files.sniffed(t.documents.select(C("doc_id").alias("path"), content.alias("content"))).select(C("path").alias("doc_id"), "encoding")


@query("SELECT doc_id, CASE WHEN length(text) > 4000 OR length(source) > 4000 THEN 'field too long' ELSE md5(text) END AS outcome FROM documents")
def csv_oversize_quarantine(t: Tables) -> DataFrame:
    good, bad = files.split_quarantine(t.documents, files.oversize(["text", "source"], 4000), "field too long", "doc_id")
    return good.select("doc_id", F.md5("text").alias("outcome")).union(bad.select("doc_id", "kind"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE c_mktsegment END AS segment, CAST(CASE c_custkey % 3 WHEN 1 THEN 2 + c_custkey % 40 ELSE 0 END AS BIGINT) AS n_extra FROM customer")
def csv_width_reconcile(t: Tables) -> DataFrame:
    """Records that are short, wide and just right."""
    k = C("c_custkey") % 3
    lines = F.concat_ws(",", C("c_custkey").cast("string"), F.when(k > 0, C("c_mktsegment")), F.when(k == 1, "x"), F.when(k == 1, "y"), F.when((k == 1) & (C("c_custkey") % 40 > 0), F.array_join(F.array_repeat(F.lit("\"z, \"\"z\""), (C("c_custkey") % 40).cast("int")), ",")))
    path = folder(t.spark, "ragged")
    t.customer.select(lines.alias("value")).write.text(path)
    rows = t.spark.read.schema("c_custkey string, segment string, _corrupt string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").csv(path)
    out = files.surplus(rows, ["c_custkey", "segment"])
    return out.select(C("c_custkey").cast("long").alias("c_custkey"), "segment", F.size("extra").cast("long").alias("n_extra"))


@query("SELECT md5(left(trim(text), 500)) AS text, trim(source) AS source FROM documents WHERE doc_id % 20 = 7 ORDER BY doc_id LIMIT 5")
def csv_preview(t: Tables) -> DataFrame:
    """The first rows of one of twenty files."""
    rows = t.documents.select((C("doc_id") % 20).alias("part"), "doc_id", "text", "source").repartition("part").sortWithinPartitions("part", "doc_id")
    path, null = csv_of(t, rows.drop("doc_id"), "part")
    return files.preview(files.read_csv(t.spark, f"{path}/part=7", ["text", "source"], null=null), ["text", "source"]).select(F.md5("text").alias("text"), "source")


@query("SELECT count(*) AS total, count(*) FILTER (length(text) > 4000) AS unreadable FROM documents")
def csv_row_counts(t: Tables) -> DataFrame:
    return t.documents.agg(n().alias("total"), F.count_if(files.oversize(["text"], 4000)).alias("unreadable"))


@query("SELECT part, line, CASE k WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not an object' ELSE props ->> 'k' END AS outcome FROM (SELECT user_id % 10 AS part, event_id % 4 AS k, row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS line, props FROM events) WHERE k < 3")
def jsonl_scan(t: Tables) -> DataFrame:
    """Ten files of good, broken, foreign and blank lines, in order of events."""
    k = C("event_id") % 4
    path = folder(t.spark, "jsonl")
    value = F.when(k == 0, C("props")).when(k == 1, F.left("props", F.lit(4))).when(k == 2, "[1]").otherwise(" ")
    rows = t.events.select((C("user_id") % 10).alias("part"), "event_id", value.alias("value")).repartition("part").sortWithinPartitions("part", "event_id")
    rows.drop("event_id").write.partitionBy("part").text(path)
    good, bad = files.read_jsonl(t.spark, path, "k long")
    both = good.select("file", "line", C("k").cast("string").alias("outcome")).union(bad.select("file", "line", "error"))
    return both.select(F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long").alias("part"), "line", "outcome")


@query("SELECT n_nationkey, n_name FROM nation WHERE (SELECT count(*) = count(DISTINCT n_name) FROM nation)")
def department_catalogue(t: Tables) -> DataFrame:
    path = folder(t.spark, "catalogue")
    t.nation.write.json(path)
    catalogue = t.spark.read.schema("n_nationkey int, n_name string").json(path)
    size = catalogue.agg(n(), F.count_distinct("n_nationkey"), F.count_distinct("n_name")).first()
    if len(set(size)) > 1:
        raise ValueError(f"the catalogue's ids and names must be unique: {size}")
    return catalogue


@query("SELECT conv_id AS file, CAST(count(*) AS BIGINT) AS n_records FROM conversations WHERE turn > 1 GROUP BY 1")
def sheet_header_rows(t: Tables) -> DataFrame:
    """Conversations as sheets whose second row names the columns."""
    cells = F.when(C("turn") == 1, F.array(F.lit(" Title "), F.lit("content"))).otherwise(F.array("role", "text"))
    sheets = t.conversations.select(C("conv_id").alias("file"), F.lit("s").alias("sheet"), C("turn").alias("row"), cells.alias("cells"))
    return files.headers_located(sheets, ["title", "제목"], ["content", "내용"]).groupBy("file").agg(n().alias("n_records"))


def cases(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Heading\n사례 "), F.lpad(C("turn").cast("string"), 3, "0"), F.lit("\n신청원인 "), C("text"), F.lit("\n피신청인 등의 주장 no"))
    return t.conversations.select(C("conv_id").cast("string").alias("file"), C("turn").cast("int").alias("page"), F.when(C("conv_id") % 4 > 0, text).otherwise(C("text")).alias("text"))


CASES = r"SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn AS INT) AS row, lpad(CAST(turn AS VARCHAR), 3, '0') AS number, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body FROM conversations WHERE conv_id % 4 > 0 UNION ALL SELECT CAST(conv_id AS VARCHAR), 1, NULL, md5(string_agg(text, chr(10) ORDER BY turn)) FROM conversations WHERE conv_id % 4 = 0 GROUP BY conv_id"


@query(CASES)
def case_pages(t: Tables) -> DataFrame:
    return files.case_pages(cases(t)).select("file", "row", "number", F.md5("body").alias("body"))


@query(r"SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn AS INT) + 1 AS row, lpad(CAST(turn AS VARCHAR), 3, '0') AS number, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS body FROM conversations")
def case_text_blocks(t: Tables) -> DataFrame:
    """All turns of a conversation in one text, cut again at their headings."""
    block = F.concat(F.lpad(C("turn").cast("string"), 2, "0"), F.lit(" part / 사례 "), F.lpad(C("turn").cast("string"), 3, "0"), F.lit("\ntitle\n신청원인 "), "text")
    whole = t.conversations.groupBy(C("conv_id").cast("string").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda s: s["b"]), "\n").alias("text"))
    whole = whole.withColumn("text", F.concat(F.lit("front\n"), "text"))
    return files.case_blocks(whole, r"^\d{2} .+?/ ?사례\s*(\d{3,})").select("file", "row", "number", F.md5("body").alias("body"))


@query("SELECT user_id AS page, max(value) AS score FROM events GROUP BY 1")
def best_page_extraction(t: Tables) -> DataFrame:
    c = t.events.select(C("user_id").alias("page"), C("event_type").alias("text"), C("value").alias("score"), C("event_id").alias("rank"))
    return files.best_candidate(c, ["page"], "score", "rank").select("page", "score")


@query("SELECT doc_id, sha256(text) AS hash FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text = d.text)")
def file_manifest(t: Tables) -> DataFrame:
    f = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("content"))
    manifest = f.where("doc_id % 2 = 0").select(F.sha2("content", 256).alias("hash")).distinct()
    return files.new_files(manifest, f.where("doc_id % 2 = 1")).select("doc_id", "hash")


@query("SELECT concat('name: ', c_name, ', segment: ', c_mktsegment) AS line FROM customer")
def labelled_text_export(t: Tables) -> DataFrame:
    path = folder(t.spark, "labelled")
    t.customer.select(F.concat_ws(", ", F.concat(F.lit("name: "), "c_name"), F.concat(F.lit("segment: "), "c_mktsegment")).alias("value")).write.text(path)
    return t.spark.read.text(path).select(C("value").alias("line"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, printf('case %d of %d', o_orderkey, o_custkey) AS shaped FROM orders")
def shaped_versions(t: Tables) -> DataFrame:
    v = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return t.orders.select("o_custkey", "o_orderkey", v.alias("version"), F.format_string("case %d of %d", "o_orderkey", "o_custkey").alias("shaped"))


@query("SELECT conv_id, count(*) AS blocks, count(*) FILTER (role = 'user') AS images, md5(string_agg(role, ' ' ORDER BY turn)) AS text FROM conversations GROUP BY 1")
def ocr_rollup(t: Tables) -> DataFrame:
    page = t.conversations.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("j"))
    b = page.select("conv_id", F.from_json("j", "array<struct<turn:long,role:string>>").alias("b"))
    return b.select("conv_id", F.size("b").cast("long").alias("blocks"), F.size(F.filter("b", lambda x: x["role"] == "user")).cast("long").alias("images"), F.md5(F.array_join("b.role", " ")).alias("text"))


@query("SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents e WHERE e.doc_id < 500 AND e.text = d.text) OR d.doc_id > (SELECT min(doc_id) FROM documents f WHERE f.text = d.text AND f.doc_id >= 500) THEN 'skipped' ELSE 'saved' END AS outcome FROM documents d WHERE doc_id >= 500")
def append_unless_duplicate(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    old, new = d.where("doc_id < 500").select("h").distinct().withColumn("known", F.lit(True)), d.where("doc_id >= 500")
    first = new.groupBy("h").agg(F.min("doc_id").alias("first"))
    j = new.join(first, "h").join(old, "h", "left")
    outcome = F.when(C("known") | (C("doc_id") > C("first")), "skipped").otherwise("saved")
    return j.select("doc_id", outcome.alias("outcome"))


@query("SELECT doc_id, md5(left(text, 2000)) AS reason, lang, md5(text) AS text FROM documents WHERE n_chars > 3000")
def failure_sink(t: Tables) -> DataFrame:
    rows = t.documents.where("n_chars > 3000")
    path = folder(t.spark, "failures")
    files.failures(rows, "doc_id", C("text")).write.parquet(path)
    raw = F.from_json("raw", "lang string, text string")
    return t.spark.read.parquet(path).select("doc_id", F.md5("reason").alias("reason"), raw["lang"].alias("lang"), F.md5(raw["text"]).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'bad' ELSE 'good' END AS part, CASE WHEN doc_id % 13 > 0 THEN md5(text) END AS digest FROM documents")
def reference_sink_isolation(t: Tables) -> DataFrame:
    good, bad = files.split_quarantine(t.documents.select("doc_id", "text"), C("doc_id") % 13 == 0, "bad", "doc_id")
    path = folder(t.spark, "sink")
    good.write.parquet(f"{path}/part=good")
    bad.write.parquet(f"{path}/part=bad")
    return t.spark.read.option("mergeSchema", True).parquet(path).select("doc_id", "part", F.md5("text").alias("digest"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag <> 'R') AND count(*) = max(l_linenumber)")
def publication_gate(t: Tables) -> DataFrame:
    ready = t.lineitem.groupBy("l_orderkey").agg((F.bool_and(C("l_returnflag") != "R") & (n() == F.max("l_linenumber"))).alias("ready"))
    return ready.where("ready").select("l_orderkey")


@query("SELECT lang, round(avg(n_chars), 4) AS mean FROM documents GROUP BY 1")
def metrics_report(t: Tables) -> DataFrame:
    path = folder(t.spark, "report")
    t.documents.groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("mean")).write.json(path)
    return t.spark.read.schema("lang string, mean double").json(path)


@query("SELECT event_type, event_id AS entity, md5(props) AS details FROM events")
def audit_append(t: Tables) -> DataFrame:
    path = folder(t.spark, "audit")
    e = t.events.select("event_type", C("event_id").alias("entity"), "props")
    e.where("entity % 2 = 0").write.parquet(path)
    e.where("entity % 2 = 1").write.mode("append").parquet(path)
    return t.spark.read.parquet(path).select("event_type", "entity", F.md5("props").alias("details"))


@query("SELECT count(*) AS n_files FROM documents WHERE strlen(text) <= 3000")
def input_size_guard(t: Tables) -> DataFrame:
    return files.within_size(t.documents.select(F.octet_length("text").alias("length")), 3000).agg(n().alias("n_files"))


MOVE = "SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'in progress' WHEN 'view' THEN 'received' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'cancelled' ELSE 'lost' END AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events"


@query(f"WITH RECURSIVE e AS ({MOVE}), f AS (SELECT user_id, 0 AS r, 'received' AS state, CAST(0 AS BIGINT) AS rejected FROM (SELECT DISTINCT user_id FROM e) UNION ALL SELECT e.user_id, CAST(e.r AS INT), CASE WHEN (f.state = 'received' AND wanted IN ('in progress', 'cancelled')) OR (f.state = 'in progress' AND wanted IN ('done', 'cancelled', 'received')) THEN wanted ELSE f.state END, f.rejected + CASE WHEN (f.state = 'received' AND wanted IN ('in progress', 'cancelled')) OR (f.state = 'in progress' AND wanted IN ('done', 'cancelled', 'received')) THEN 0 ELSE 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT user_id, state, rejected FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1")
def status_fold(t: Tables) -> DataFrame:
    e = C("event_type")
    wanted = F.when(e == "click", "in progress").when(e == "view", "received").when(e == "purchase", "done").when(e == "error", "cancelled").otherwise("lost")
    return lifecycle.fold(t.events.select("user_id", "event_id", wanted.alias("wanted")), "user_id", "event_id", "wanted")


@query("WITH r AS (SELECT user_id, count(*) AS revision FROM events GROUP BY 1), x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS revision FROM events) SELECT user_id, x.revision, CASE WHEN x.revision = r.revision THEN 'applied' ELSE 'late' END AS outcome FROM x JOIN r USING (user_id)")
def revision_guard(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id").agg(n().alias("revision"))
    results = t.events.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("revision"))
    fits, late = lifecycle.current_results(results, rows, "user_id", "revision")
    return fits.select("user_id", "revision", F.lit("applied").alias("outcome")).union(late.select("user_id", "revision", F.lit("late")))


@query("SELECT user_id FROM events GROUP BY 1 HAVING epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) > 36000")
def stale_heartbeat(t: Tables) -> DataFrame:
    beats = t.events.groupBy("user_id").agg(F.max("ts").alias("beat"))
    return lifecycle.stale(beats, "beat", F.lit("2024-01-31 00:00:00").cast("timestamp"), 36000).select("user_id")


@query("SELECT user_id, event_type AS author, max(event_id) AS event_id FROM events GROUP BY 1, 2 HAVING arg_max(event_id % 3, event_id) > 0")
def drafts_left(t: Tables) -> DataFrame:
    e = t.events.select("user_id", C("event_type").alias("author"), "event_id", F.when(C("event_id") % 3 > 0, "draft").otherwise("sent").alias("kind"))
    return lifecycle.drafts_left(e, "user_id", "author", "event_id", "kind")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN 'done' ELSE 'received' END AS status, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS owner FROM orders")
def archive_and_restore(t: Tables) -> DataFrame:
    put = lifecycle.archived(t.orders, C("o_orderkey") % 4 == 0, "o_orderstatus", "o_custkey")
    back = lifecycle.restored(put.withColumnRenamed("o_orderstatus", "status"), "status", C("o_orderkey") % 2 == 0)
    return back.select("o_orderkey", "status", C("o_custkey").alias("owner"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 40")
def bounded_retention(t: Tables) -> DataFrame:
    return lifecycle.bounded(t.events, "user_id", [C("event_id")], 40).select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND NOT (l_linenumber % 2 = 0 AND l_partkey % 2 = 0)")
def pending_long_chunks(t: Tables) -> DataFrame:
    chunks = t.lineitem.where("l_quantity > 45").select("l_orderkey", "l_linenumber", F.md5(C("l_partkey").cast("string")).alias("hash"))
    done = t.lineitem.where("l_linenumber % 2 = 0 and l_partkey % 2 = 0").select("l_orderkey", "l_linenumber", F.md5(C("l_partkey").cast("string")).alias("hash"))
    return lifecycle.pending_chunks(chunks, done, ["l_orderkey", "l_linenumber", "hash"]).select("l_orderkey", "l_linenumber")


CALLS = "SELECT user_id, event_id, event_type = 'error' AS bad, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS r FROM events"


@query(f"WITH RECURSIVE e AS ({CALLS}), f AS (SELECT user_id, event_id, r, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS outcome, CASE WHEN bad THEN sec + 3600 ELSE 0 END AS until FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN sec < until THEN 'skipped' WHEN bad THEN 'failed' ELSE 'ok' END, CASE WHEN bad AND sec >= until THEN sec + 3600 ELSE until END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT user_id, event_id, outcome FROM f")
def call_breaker(t: Tables) -> DataFrame:
    """Calls after a failure are skipped for an hour."""
    e = t.events.withColumn("at", F.unix_timestamp("ts"))
    return lifecycle.with_breaker(e, "event_id", C("event_type") == "error", "user_id", "at", 3600)


@query("SELECT o_orderkey, 'all in scope' AS request FROM orders WHERE o_orderkey % 100 <> 5 UNION ALL SELECT o_orderkey, 'some out of scope' FROM orders")
def delete_all_or_nothing(t: Tables) -> DataFrame:
    """What each of two requests leaves."""
    o = t.orders.select("o_orderkey", "o_orderstatus")
    ids = o.where("o_orderkey % 100 = 5")
    left = lambda scope, name: lifecycle.deleted(o, "o_orderkey", ids, scope).select("o_orderkey", F.lit(name).alias("request"))
    return left(F.lit(True), "all in scope").union(left(C("o_orderstatus") == "F", "some out of scope"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant' AND turn < m) AS stubs FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY 1")
def history_compaction(t: Tables) -> DataFrame:
    turns = t.conversations.withColumn("role", F.when(C("role") == "assistant", "tool").otherwise(C("role")))
    out = lifecycle.compacted(turns, "conv_id", "turn", "role", "text")
    return out.groupBy("conv_id").agg(F.count_if(C("text") == "(earlier result)").alias("stubs"))


@query("SELECT DISTINCT md5(text) AS digest FROM documents")
def incremental_dedup_load(t: Tables) -> DataFrame:
    """Documents as a stream of files, each loaded once and only where its content is new."""
    source, target = folder(t.spark, "incoming"), folder(t.spark, "loaded")
    d = t.documents.select("doc_id", "text")
    d.repartition(6, "doc_id").write.parquet(source)
    loads.load_new(loads.file_stream(t.spark, source, d.schema, 2), target, folder(t.spark, "progress"), "text", "doc_id", buckets=16)
    return t.spark.read.parquet(target).select(F.md5("text").alias("digest"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_rows FROM events GROUP BY 1")
def watermark_dedup(t: Tables) -> DataFrame:
    """First events of a user and type, within a watermark that spans the month."""
    source, target = folder(t.spark, "events"), folder(t.spark, "firsts")
    e = t.events.select("user_id", "event_type", C("ts").cast("timestamp").alias("ts"))
    e.repartition(2, "user_id").write.parquet(source)
    first = loads.deduplicated(loads.file_stream(t.spark, source, e.schema, 8), ["user_id", "event_type"], "ts", "60 days")
    loads.run_to_end(first, folder(t.spark, "progress"), lambda b, i: b.write.mode("overwrite").parquet(f"{target}/load={i}"))
    return t.spark.read.parquet(target).groupBy("event_type").agg(n().alias("n_rows"))


def arriving(t: Tables, rows: DataFrame, part: Column, parts: int, last: DataFrame | None = None) -> Iterator[DataFrame]:
    """A stream of files to which ``rows`` come in ``parts`` parts, then ``last``: given once after each, to be run to its end from where it stood."""
    source, rows = folder(t.spark, "arriving"), stored(rows, "rows")
    for more in [*(rows.where(part == i) for i in range(parts)), *([] if last is None else [last])]:
        more.write.mode("append").parquet(source)
        yield loads.file_stream(t.spark, source, rows.schema, 1000)


def in_order(rows: DataFrame, by: Column, parts: int) -> Column:
    """Which of ``parts`` equal stretches of ``by`` a row lies in."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    return F.floor((by - F.lit(low)) * parts / F.lit((high or 0) - (low or 0) + 1))


def numbered(target: str) -> Callable[[DataFrame, int], None]:
    """Write each batch into a folder of its number."""
    return lambda batch, i: batch.write.mode("overwrite").parquet(f"{target}/load={i}")


GAPS = "SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS beat, lead(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS back FROM events"


@query(f"SELECT user_id, beat, back FROM ({GAPS}) WHERE coalesce(back, CAST(epoch(TIMESTAMP '2024-02-02 00:00:00') AS BIGINT)) - beat > 36000")
def silences_by_timer(t: Tables) -> DataFrame:
    """Every silence of more than ten hours: told by timers while the stream runs, closed when the user comes back."""
    e = t.events.select("user_id", C("ts").cast("timestamp").alias("ts"))
    clock = t.spark.sql("select cast(null as bigint) as user_id, timestamp '2024-02-02 00:00:00' as ts")
    target, progress = folder(t.spark, "told"), folder(t.spark, "progress")
    for stream in arriving(t, e, in_order(e, F.unix_timestamp("ts"), 3), 3, clock):
        state.run_keyed(state.stale_stream(stream, "user_id", "ts", 36000), progress, numbered(target))
    found = t.spark.read.schema("user_id long, kind string, beat long, back long").parquet(target)
    back = found.where("kind = 'back'").select("user_id", "beat", "back")
    return found.where("kind = 'stale'").select("user_id", "beat").join(back, ["user_id", "beat"], "left")


@query(SQL["call_breaker"])
def breaker_by_state(t: Tables) -> DataFrame:
    """The outcomes of ``call_breaker`` from a stream, with one number kept for each user in an open hour."""
    e = t.events.select("user_id", "event_id", C("ts").cast("timestamp").alias("ts"), (C("event_type") == "error").alias("bad"))
    target, progress = folder(t.spark, "outcomes"), folder(t.spark, "progress")
    for stream in arriving(t, e, in_order(e, F.unix_timestamp("ts"), 3), 3):
        state.run_keyed(state.breaker_stream(stream, "user_id", "event_id", "ts", "bad", 3600), progress, numbered(target))
    return t.spark.read.parquet(target).select("user_id", "event_id", "outcome")


@query(SQL["status_fold"])
def status_by_state(t: Tables) -> DataFrame:
    """The states of ``status_fold`` from a stream of events that come in order."""
    e = C("event_type")
    wanted = F.when(e == "click", "in progress").when(e == "view", "received").when(e == "purchase", "done").when(e == "error", "cancelled").otherwise("lost")
    target, progress = folder(t.spark, "states"), folder(t.spark, "progress")
    rows = t.events.select("user_id", "event_id", wanted.alias("wanted"))
    for stream in arriving(t, rows, in_order(rows, C("event_id"), 3), 3):
        state.run_keyed(state.status_stream(stream, "user_id", "event_id", "wanted"), progress, numbered(target))
    last = t.spark.read.parquet(target).groupBy("user_id").agg(F.max_by(F.struct("state", "rejected"), "last").alias("s"))
    return last.select("user_id", "s.*")


ROOM, SPARE, LOADS = 500, 20, 5
KEPT = "l[1:len(l) - CASE WHEN len(l) + len(n) - {0} > 0 THEN least(len(l), greatest(len(l) + len(n) - {0}, CASE WHEN len(n) > {1} THEN len(n) + {1} ELSE {1} END)) ELSE 0 END]".format(ROOM, SPARE)


@query(
    f"WITH RECURSIVE b AS (SELECT event_id % {LOADS} AS k, list(event_id ORDER BY event_id) AS n FROM events GROUP BY 1), "
    f"s AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS l UNION ALL SELECT s.k + 1, CASE WHEN len(m) > {ROOM} THEN m[1:{ROOM - SPARE}] ELSE m END FROM (SELECT s.k, list_sort(list_concat({KEPT}, n)) AS m FROM s JOIN b ON b.k = s.k) s) "
    f"SELECT unnest(l) AS event_id FROM s WHERE k = {LOADS}"
)
def retention_in_load(t: Tables) -> DataFrame:
    """Five loads into a table that holds 500 rows: room is made among the newest rows before each."""
    target, progress = folder(t.spark, "kept"), folder(t.spark, "progress")
    for stream in arriving(t, t.events.select("event_id", "user_id"), C("event_id") % LOADS, LOADS):
        loads.retain(stream, target, progress, ["event_id"], ROOM, SPARE)
    return loads.retained(t.spark, target).select("event_id")
