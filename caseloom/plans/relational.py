"""Queries on scopes, joins and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import lookups, policy
from caseloom.plans.registry import Tables, query

C = F.col
n = lambda c="*": F.count(c)


@query("SELECT conv_id, role AS last_role, CAST(length(text) AS BIGINT) AS last_chars, md5(text) AS last_md5, turn AS last_turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1")
def latest_turn_per_conversation(t: Tables) -> DataFrame:
    best = t.conversations.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("m"))
    return best.select("conv_id", C("m.role").alias("last_role"), F.length("m.text").cast("long").alias("last_chars"), F.md5("m.text").alias("last_md5"), C("m.turn").alias("last_turn"))


@query("SELECT o_orderstatus, count(*) AS n_rows, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_custkey = 7 OR o_custkey = 11 GROUP BY 1")
def scope_by_owner(t: Tables) -> DataFrame:
    own = policy.scope(C("o_custkey"), C("o_orderpriority"), user=7) | policy.scope(C("o_custkey"), C("o_orderpriority"), user=11)
    return t.orders.where(own).groupBy("o_orderstatus").agg(n().alias("n_rows"), F.sum(F.round(C("o_totalprice") * 100).cast("long")).alias("cents"))


@query("SELECT o_orderpriority, count(*) AS n_rows FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1")
def scope_by_department(t: Tables) -> DataFrame:
    return t.orders.where(policy.scope(C("o_custkey"), C("o_orderpriority"), own_department="2-HIGH")).groupBy("o_orderpriority").agg(n().alias("n_rows"))


ORDER_STATE = "SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS deleted_at, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN 1 END AS cancelled_by, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey % 8 END AS department FROM orders"


def order_state(t: Tables) -> DataFrame:
    """Orders as cases: some without a status, some deleted, some cancelled by their owner or by another."""
    k = C("o_orderkey")
    return t.orders.withColumns({
        "status": F.when(k % 7 != 0, C("o_orderstatus")), "deleted_at": F.when(k % 5 == 0, C("o_orderdate")),
        "cancelled_by": F.when(k % 3 == 0, C("o_custkey")).when(k % 3 == 1, F.lit(1)), "department": F.when(k % 11 > 0, C("o_custkey") % 8),
    })


@query(f"SELECT status, count(*) AS n_rows FROM ({ORDER_STATE}) WHERE deleted_at IS NULL AND status IS DISTINCT FROM 'P' GROUP BY 1")
def active_rows(t: Tables) -> DataFrame:
    return order_state(t).where(policy.active(C("status"), C("deleted_at"), "P")).groupBy("status").agg(n().alias("n_rows"))


@query(f"SELECT o_orderpriority, count(*) AS n_rows FROM ({ORDER_STATE}) WHERE deleted_at IS NOT NULL OR (status IS NOT DISTINCT FROM 'P' AND NOT coalesce(cancelled_by = o_custkey, false)) GROUP BY 1")
def trash_seen_by_citizens(t: Tables) -> DataFrame:
    seen = policy.in_trash(C("deleted_at"), C("status"), C("cancelled_by") == C("o_custkey"), "P", citizen=True)
    return order_state(t).where(seen).groupBy("o_orderpriority").agg(n().alias("n_rows"))


@query(f"SELECT o_orderstatus, count(*) AS n_rows FROM ({ORDER_STATE}) WHERE NOT (cancelled_by IS NOT DISTINCT FROM o_custkey AND cancelled_by IS NOT NULL) GROUP BY 1")
def self_cancelled_hidden(t: Tables) -> DataFrame:
    return order_state(t).where(policy.not_self_cancelled(C("cancelled_by"), C("o_custkey"))).groupBy("o_orderstatus").agg(n().alias("n_rows"))


@query("SELECT CASE WHEN nullif(trim(f), '') IS NULL THEN 'user' ELSE 'file' END AS origin, lang, count(*) AS n_rows FROM (SELECT lang, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '  ' END AS f FROM documents) GROUP BY 1, 2")
def provenance_counts(t: Tables) -> DataFrame:
    f = F.when(C("doc_id") % 3 == 0, C("source")).when(C("doc_id") % 3 == 1, F.lit("  "))
    return t.documents.select("lang", policy.provenance(f).alias("origin")).groupBy("origin", "lang").agg(n().alias("n_rows"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2")
def optional_filters(t: Tables) -> DataFrame:
    on = policy.optional(C("o_orderpriority"), "1-URGENT") & policy.optional(C("o_orderstatus"), None)
    return t.orders.where(on).groupBy("o_orderstatus", "o_orderpriority").agg(n().alias("n_rows"))


VIEW = f"SELECT CASE WHEN NOT coalesce(department IN (1, 2, 3), false) THEN 'unassigned' WHEN status IS NOT DISTINCT FROM 'F' THEN 'closed' WHEN EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.o_orderkey AND l.l_returnflag = 'A') THEN 'answered' ELSE 'waiting' END AS view_status, o_orderkey, department FROM ({ORDER_STATE}) s"


def viewed(t: Tables) -> DataFrame:
    replied = t.lineitem.where("l_returnflag = 'A'").select(C("l_orderkey").alias("o_orderkey"), F.lit(True).alias("replied")).distinct()
    rows = order_state(t).join(replied, "o_orderkey", "left")
    status = policy.view_status(lookups.flagged(C("department").isin(1, 2, 3)), lookups.flagged(C("replied")), C("status"), "F")
    return rows.select("o_orderkey", "department", status.alias("view_status"))


@query(f"SELECT view_status, count(*) AS n_rows FROM ({VIEW}) GROUP BY 1")
def view_status_labels(t: Tables) -> DataFrame:
    return viewed(t).groupBy("view_status").agg(n().alias("n_rows"))


@query(f"SELECT department, count(*) AS n_rows FROM ({VIEW}) WHERE view_status = 'waiting' GROUP BY 1")
def view_status_filter(t: Tables) -> DataFrame:
    return viewed(t).where("view_status = 'waiting'").groupBy("department").agg(n().alias("n_rows"))


@query(f"SELECT CASE WHEN status IS NOT DISTINCT FROM 'P' THEN '(cancelled)' ELSE o_orderpriority END AS shown, count(*) AS n_rows FROM ({ORDER_STATE}) GROUP BY 1")
def cancelled_content_masked(t: Tables) -> DataFrame:
    return order_state(t).groupBy(policy.masked(C("status"), "P", C("o_orderpriority"), "(cancelled)").alias("shown")).agg(n().alias("n_rows"))


@query(f"SELECT department, count(*) FILTER (coalesce(department = 3, false) OR (deleted_at IS NOT NULL AND department IS NULL)) AS managed, count(*) AS n_rows FROM ({ORDER_STATE}) GROUP BY 1")
def manage_flags(t: Tables) -> DataFrame:
    flag = policy.can_manage("staff", 3, C("department"), C("deleted_at"))
    return order_state(t).groupBy("department").agg(F.count_if(flag).alias("managed"), n().alias("n_rows"))


@query("SELECT c.conv_id, c.role AS first_role, coalesce(md5(r.text), '') AS reply_md5, CASE WHEN c.conv_id % 2 = 0 THEN 'file' ELSE 'user' END AS origin FROM conversations c LEFT JOIN (SELECT conv_id, text FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1) r USING (conv_id) WHERE c.turn = 0")
def public_projection(t: Tables) -> DataFrame:
    replies = t.conversations.where("role = 'assistant'").withColumn("digest", F.md5("text"))
    out = lookups.with_latest(t.conversations.where("turn = 0").select("conv_id", "role"), replies, "conv_id", ["turn", "text"], "digest", "reply_md5")
    source = F.when(C("conv_id") % 2 == 0, F.lit("f.csv"))
    return out.select("conv_id", C("role").alias("first_role"), "reply_md5", policy.provenance(source).alias("origin"))


@query("SELECT o_orderstatus, count(*) AS n_rows FROM (SELECT *, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS f, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) + 400 END AS u FROM orders) WHERE o_orderstatus <> 'P' AND (f IS NULL OR f <= DATE '1998-06-01') AND (u IS NULL OR u >= DATE '1998-06-01') GROUP BY 1")
def documents_in_force(t: Tables) -> DataFrame:
    day = C("o_orderdate").cast("date")
    ok = policy.in_force(F.when(C("o_orderkey") % 4 > 0, day), F.when(C("o_orderkey") % 3 > 0, F.date_add(day, 400)), "1998-06-01")
    return t.orders.where((C("o_orderstatus") != "P") & ok).groupBy("o_orderstatus").agg(n().alias("n_rows"))


@query("SELECT i.item_id, count(*) AS n_rows FROM benchmark i JOIN nation d ON (NOT (regexp_matches(i.text, 'tion') AND NOT regexp_matches(i.text, 'that')) OR coalesce(CASE d.n_nationkey % 3 WHEN 0 THEN 'alone' WHEN 1 THEN 'shared' END, '') <> 'alone') AND (NOT (regexp_matches(i.text, 'that') AND NOT regexp_matches(i.text, 'tion')) OR coalesce(CASE d.n_nationkey % 3 WHEN 0 THEN 'alone' WHEN 1 THEN 'shared' END, '') <> 'shared') GROUP BY 1")
def applicability_excluded(t: Tables) -> DataFrame:
    scopes = t.nation.select("n_nationkey", F.when(C("n_nationkey") % 3 == 0, "alone").when(C("n_nationkey") % 3 == 1, "shared").alias("scope")).groupBy(F.coalesce("scope", F.lit("")).alias("scope")).agg(n().alias("k"))
    shared, alone = C("text").rlike("tion"), C("text").rlike("that")
    barred = F.when(shared & ~alone, "alone").when(alone & ~shared, "shared").otherwise("-")
    asked = t.benchmark.select("item_id", F.explode(F.array_except(F.array(F.lit("alone"), F.lit("shared"), F.lit("")), F.array(barred))).alias("scope"))
    return asked.join(scopes, "scope").groupBy("item_id").agg(F.sum("k").alias("n_rows"))


@query("SELECT lang, CASE WHEN len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) > 400 THEN 'deferred' ELSE 'whole' END AS route, count(*) AS n_rows FROM documents GROUP BY 1, 2")
def length_routes(t: Tables) -> DataFrame:
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)))
    return t.documents.groupBy("lang", F.when(words > 400, "deferred").otherwise("whole").alias("route")).agg(n().alias("n_rows"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND user_id = 8 ORDER BY event_id DESC LIMIT 100 OFFSET 20")
def failure_page(t: Tables) -> DataFrame:
    return t.events.where(C("event_type").isin("error", "signup") & (C("user_id") == 8)).select("event_id", "user_id", "event_type").orderBy(C("event_id").desc()).offset(20).limit(100)


@query("SELECT n_name, count(*) AS n_customers, count(*) FILTER (c_acctbal < 0) AS in_debt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def counts_per_dimension(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).groupBy("n_name").agg(n().alias("n_customers"), F.count_if(C("c_acctbal") < 0).alias("in_debt"))


@query("SELECT n_name, count(c_custkey) AS n_rich FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9500 GROUP BY 1")
def counts_keep_empty(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 9500").groupBy(C("c_nationkey").alias("n_nationkey")).agg(n().alias("k"))
    return t.nation.join(rich, "n_nationkey", "left").select("n_name", F.coalesce("k", F.lit(0)).alias("n_rich"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def reply_author_join(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 400000").join(t.customer, C("o_custkey") == C("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_mktsegment, count(*) AS n_rows FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY 1")
def customers_with_orders(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), C("c_custkey") == C("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(n().alias("n_rows"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def customers_without_orders(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 100000"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT s_suppkey, coalesce(n_name, 'unassigned ' || CAST(s_nationkey AS VARCHAR)) AS shown FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 > 0) ON s_nationkey = n_nationkey")
def name_or_fallback(t: Tables) -> DataFrame:
    names = t.nation.where("n_nationkey % 4 > 0").select(C("n_nationkey").alias("s_nationkey"), "n_name")
    rows = t.supplier.withColumn("other", F.concat(F.lit("unassigned "), C("s_nationkey").cast("string")))
    return lookups.name_or(rows, names, "s_nationkey", "n_name", "other", "shown").select("s_suppkey", "shown")


@query("WITH c AS (SELECT n_name AS name, [lower(n_name), 'N' || CAST(n_nationkey AS VARCHAR), 'NATION_' || CAST((n_nationkey + 1) AS VARCHAR)] AS aliases FROM nation WHERE n_nationkey < 20), s AS (SELECT name, name AS spelling, 0 AS r FROM c UNION ALL SELECT name, unnest(aliases), 1 FROM c), b AS (SELECT spelling, arg_min(name, (r, name)) AS name FROM s GROUP BY 1), v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NATION_' || CAST(c_nationkey AS VARCHAR) WHEN 1 THEN 'nation_' || CAST(c_nationkey AS VARCHAR) WHEN 2 THEN 'N' || CAST(c_nationkey AS VARCHAR) ELSE 'elsewhere' END AS v FROM customer) SELECT c_custkey, coalesce(b.name, 'OTHER') AS canonical FROM v LEFT JOIN b ON v.v = b.spelling")
def alias_resolution(t: Tables) -> DataFrame:
    key = C("n_nationkey").cast("string")
    catalogue = t.nation.where("n_nationkey < 20").select(C("n_name").alias("name"), F.array(F.lower("n_name"), F.concat(F.lit("N"), key), F.concat(F.lit("NATION_"), (C("n_nationkey") + 1).cast("string"))).alias("aliases"))
    k, nk = C("c_custkey") % 4, C("c_nationkey").cast("string")
    said = F.when(k == 0, F.concat(F.lit("NATION_"), nk)).when(k == 1, F.concat(F.lit("nation_"), nk)).when(k == 2, F.concat(F.lit("N"), nk)).otherwise("elsewhere")
    return lookups.resolve_alias(t.customer.select("c_custkey", said.alias("said")), "said", catalogue, "name", "aliases", "OTHER", "canonical").select("c_custkey", "canonical")


@query("SELECT d.doc_id, min(e.doc_id) AS match_id FROM documents d JOIN documents e ON md5(d.text) = md5(e.text) AND d.text = e.text WHERE d.doc_id % 2 = 1 AND e.doc_id % 2 = 0 GROUP BY 1")
def hash_narrowed_match(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text")
    return lookups.same_content(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "text", keep="doc_id").select("doc_id", "match_id")


@query("SELECT p.conv_id, p.turn AS parent_turn, c.turn AS child_turn, md5(p.text) AS parent_md5, (SELECT count(*) FROM conversations x WHERE x.conv_id = p.conv_id AND x.turn < c.turn) AS inherited FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.role = 'user'")
def follow_up_with_parent(t: Tables) -> DataFrame:
    c = t.conversations
    child = c.where("role = 'user'").select("conv_id", C("turn").alias("child_turn"), (C("turn") - 1).alias("parent_turn"))
    parent = c.select("conv_id", C("turn").alias("parent_turn"), F.md5("text").alias("parent_md5"))
    before = c.select("conv_id", "turn")
    pairs = child.join(parent, ["conv_id", "parent_turn"])
    seen = child.select("conv_id", "child_turn").join(before, "conv_id").where("turn < child_turn").groupBy("conv_id", "child_turn").agg(n().alias("inherited"))
    return pairs.join(seen, ["conv_id", "child_turn"]).select("conv_id", "parent_turn", "child_turn", "parent_md5", "inherited")


@query("SELECT 'orders_key_unique' AS constraint_name, count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'line_key_unique', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'order_of_line', count(*) FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'customer_of_order', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'status_domain', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'discount_range', count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.1)")
def constraint_audit(t: Tables) -> DataFrame:
    return lookups.audit({
        "orders_key_unique": lookups.duplicates(t.orders, ["o_orderkey"]), "line_key_unique": lookups.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]),
        "order_of_line": lookups.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey"), "customer_of_order": lookups.orphans(t.orders, "o_custkey", t.customer, "c_custkey"),
        "status_domain": t.orders.where(~C("o_orderstatus").isin("F", "O")), "discount_range": t.lineitem.where(~C("l_discount").between(0, 0.1)),
    })


@query("SELECT c_custkey, coalesce(link, CAST(n_regionkey AS BIGINT)) AS link FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS link FROM customer) LEFT JOIN nation ON c_nationkey = n_nationkey")
def update_null_links(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", C("c_nationkey").alias("n_nationkey"), F.when(C("c_custkey") % 3 == 0, C("c_custkey")).alias("link"))
    return lookups.fill_null_links(rows, "link", t.nation.withColumn("region", C("n_regionkey").cast("long")), "n_nationkey", "region").select("c_custkey", "link")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderkey % 17 <> 0")
def snapshot_unchanged(t: Tables) -> DataFrame:
    before = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.where("o_orderkey % 17 <> 0").withColumn("o_totalprice", F.when(C("o_orderkey") % 10 == 3, C("o_totalprice") + 1).otherwise(C("o_totalprice")))
    return lookups.unchanged(before, after, "o_orderkey").select("o_orderkey")


UPSERT = "WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 < 2), w AS (SELECT o_orderkey, 'new ' || o_orderstatus AS o_orderstatus FROM orders WHERE o_orderkey % 3 > 0)"


@query(UPSERT + " SELECT o_orderstatus, count(*) AS n_rows FROM (SELECT * FROM w UNION ALL SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM w)) GROUP BY 1")
def upsert_latest_wins(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 > 0").withColumn("o_orderstatus", F.concat(F.lit("new "), "o_orderstatus"))
    return lookups.upsert(o.where("o_orderkey % 3 < 2"), new, ["o_orderkey"]).groupBy("o_orderstatus").agg(n().alias("n_rows"))


@query(UPSERT + " SELECT o_orderstatus, count(*) AS n_rows FROM (SELECT * FROM o UNION ALL SELECT * FROM w WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)) GROUP BY 1")
def insert_or_ignore(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 3 > 0").withColumn("o_orderstatus", F.concat(F.lit("new "), "o_orderstatus"))
    return lookups.upsert(o.where("o_orderkey % 3 < 2"), new, ["o_orderkey"], replace=False).groupBy("o_orderstatus").agg(n().alias("n_rows"))


@query("SELECT l_returnflag, count(*) AS n_rows FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1")
def cascade_survivors(t: Tables) -> DataFrame:
    return lookups.cascade(t.lineitem, "l_orderkey", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey").groupBy("l_returnflag").agg(n().alias("n_rows"))


@query("WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN o_orderkey - 1 END AS parent FROM orders WHERE o_orderkey % 5 <> 2) SELECT r.o_orderkey, p.o_orderkey AS parent FROM r LEFT JOIN r p ON p.o_orderkey = r.parent")
def self_reference_nulled(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderkey % 5 <> 2").select("o_orderkey", F.when(C("o_orderkey") > 0, C("o_orderkey") - 1).alias("parent"))
    return lookups.nulled_references(rows, "o_orderkey", "parent").select("o_orderkey", "parent")
