"""Queries on clauses, chunks, versions, citations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.functions import tables
from caseloom.operators import evidence
from caseloom.operators.running import running_total
from caseloom.operators.vector_index import VectorIndex
from caseloom.plans.registry import SQL, Tables, query
from caseloom.sources.scratch import stored

C = F.col
n = lambda c="*": F.count(c)


def laws(t: Tables, n_laws: int = 300) -> DataFrame:
    """Documents as laws: each line an article, some of which cite others (of ``n_laws``), define a term or state an exception."""
    cites = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        F.lit("제"), (i + 1).cast("string"), F.lit("조"), F.when(i == 0, "(정의)").otherwise("(내용)"), F.lit("\n"), F.when(i == 0, '"the"라 한다. ').otherwise(""), x,
        F.when(i % 3 == 1, F.concat(F.lit(" 제"), (i + 2).cast("string"), F.lit("조에 따른다."))).otherwise(""),
        F.when(i % 7 == 4, F.concat(F.lit(" 「law "), ((C("doc_id") * 7 + i) % n_laws).cast("string"), F.lit("」 제1조에 따른다."))).otherwise(""),
        F.when(i % 11 == 6, F.concat(F.lit(" 다만, 제"), i.cast("string"), F.lit("조는 그러하지 아니하다."))).otherwise(""),
    ))
    return t.documents.select("doc_id", F.array_join(cites, "\n").alias("text"))


#: The articles of ``laws``: ``k`` of them in each document, with their lines.
ARTICLES = "x AS (SELECT doc_id, k, i, concat('제', i + 1, '조', CASE WHEN i = 0 THEN '(정의)' ELSE '(내용)' END, chr(10), CASE WHEN i = 0 THEN '\"the\"라 한다. ' END, ls[i + 1], CASE WHEN i % 3 = 1 THEN concat(' 제', i + 2, '조에 따른다.') END, CASE WHEN i % 7 = 4 THEN concat(' 「law ', (doc_id * 7 + i) % 300, '」 제1조에 따른다.') END, CASE WHEN i % 11 = 6 THEN concat(' 다만, 제', i, '조는 그러하지 아니하다.') END) AS line FROM (SELECT doc_id, ls, len(ls) AS k, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


# What the clause parser reads as white space, clauses and citations of other laws, as DuckDB writes it.
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
SAID_CLAUSE = rf"제{BLANK}*\p{{Nd}}+{BLANK}*조(?:{BLANK}*의{BLANK}*\p{{Nd}}+)?|별표{BLANK}*\p{{Nd}}+(?:{BLANK}*의{BLANK}*\p{{Nd}}+)?"
NAME = '[^「」『』“”"\\n]{1,200}'
SAID_CITATION = rf'(?:「{NAME}」|『{NAME}』|“{NAME}”|"{NAME}"|[가-힣A-Za-z0-9·ㆍ]{{1,120}}(?:법률|시행령|시행규칙|조례|규칙|법)){BLANK}*(?:{SAID_CLAUSE})'
squeezed_sql = lambda c: f"regexp_replace({c}, '{BLANK}+', '', 'g')"
#: ``c``: the articles with the distinct clauses that each cites of its own law, and (law, ref) of each clause that follows the name of another.
CITES = f"{ARTICLES}, m AS (SELECT *, list_transform(regexp_extract_all(line, '{SAID_CITATION}'), lambda q: {{'law': regexp_replace(regexp_replace(regexp_replace(q, '{BLANK}*(?:{SAID_CLAUSE})$', ''), '^[「『“\"]|[」』”\"]$', '', 'g'), '^{BLANK}+|{BLANK}+$', '', 'g'), 'ref': {squeezed_sql(f"regexp_extract(q, '(?:{SAID_CLAUSE})$')")}}}) AS named FROM x), c AS (SELECT doc_id, k, i, list_filter(named, lambda q: q.law NOT IN ('법', '법률')) AS external, list_distinct(list_transform(regexp_extract_all(regexp_replace(line, '{SAID_CITATION}', '|', 'g'), '{SAID_CLAUSE}'), lambda q: {squeezed_sql('q')}) || list_transform(list_filter(named, lambda q: q.law IN ('법', '법률')), lambda q: q.ref) || CASE WHEN i > 0 AND contains(line, '전조') THEN [concat('제', i, '조')] ELSE [] END || CASE WHEN i + 1 < k AND contains(line, '다음 조') THEN [concat('제', i + 2, '조')] ELSE [] END) AS internal FROM m)"


@query(f"WITH {CITES} SELECT doc_id, count(*) AS n_articles, CAST(count(*) FILTER (list_contains(internal, concat('제', i + 2, '조'))) AS BIGINT) AS cited FROM c GROUP BY 1")
def clause_edges(t: Tables) -> DataFrame:
    c = evidence.clause_table(laws(t))
    own = F.size(F.filter("internal", lambda r: r == F.concat(F.lit("제"), (C("number") + 2).cast("string"), F.lit("조"))))
    return c.groupBy("doc_id").agg(n().alias("n_articles"), F.sum((own > 0).cast("long")).alias("cited"))


@query(SQL["clause_edges"])
def clause_edges_in_sql(t: Tables) -> DataFrame:
    """The rows of ``clause_edges``, asked in SQL alone."""
    tables.register(t.spark)
    laws(t).createOrReplaceTempView("laws_of_documents")
    return t.spark.sql("""
        SELECT doc_id, count(*) AS n_articles, count_if(array_contains(c.internal, concat('제', c.number + 2, '조'))) AS cited
        FROM laws_of_documents d, LATERAL clauses_of(d.text) c GROUP BY doc_id""")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n_tokens, md5(text) AS digest FROM documents WHERE text <> ''")
def chunks_in_sql(t: Tables) -> DataFrame:
    """Chunks of at most 500 characters, asked in SQL alone: put together again they are the text."""
    tables.register(t.spark)
    t.documents.createOrReplaceTempView("documents_to_cut")
    return t.spark.sql("""
        SELECT doc_id, sum(c.tokens) AS n_tokens, md5(array_join(transform(array_sort(collect_list(struct(c.chunk, c.content))), x -> x.content), '')) AS digest
        FROM documents_to_cut d, LATERAL chunks_of(d.text, 500, 'characters') c GROUP BY doc_id HAVING max(c.tokens) <= 500""")


@query("SELECT doc_id, true AS whole, doc_id % 5 > 2 OR text = '' AS altered FROM documents")
def span_proof(t: Tables) -> DataFrame:
    """Chunks of at most 400 words cover every character of every document once; altered, missing and shifted ones are told."""
    chunks = stored(evidence.chunk_table(t.documents, 400), "chunks")
    k, first = C("doc_id") % 5, C("chunk") == 0
    whole = evidence.span_proof(chunks, t.documents).select("doc_id", C("proven").alias("whole"))
    spoilt = chunks.where((k != 1) | ~first).withColumn("content", F.when((k == 0) & first, F.concat(F.lit("\u0001"), F.substring("content", F.lit(2), F.length("content")))).otherwise(C("content")))
    spoilt = spoilt.withColumn("end", F.when(k == 2, C("end") - 1).otherwise(C("end")))
    return evidence.span_proof(spoilt, t.documents).join(whole, "doc_id").select("doc_id", "whole", C("proven").alias("altered"))


@query()
def chunk_spans(t: Tables) -> DataFrame:
    return evidence.chunk_table(laws(t), 400).select("doc_id", "chunk", "start", "end", "tokens")


ENDS = "SELECT doc_id, list(e ORDER BY i) AS ends FROM (SELECT doc_id, i, sum(CASE WHEN c IN ('\"', '\\', chr(8), chr(9), chr(10), chr(12), chr(13)) THEN 2 WHEN ord(c) < 32 THEN 6 ELSE strlen(c) END) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> '')) GROUP BY 1"


@query(f"WITH RECURSIVE d AS MATERIALIZED ({ENDS}), p AS (SELECT doc_id, -1 AS piece, 0 AS start, 0 AS stop FROM d UNION ALL SELECT p.doc_id, piece + 1, stop, len(list_filter(ends, lambda x: x <= CASE WHEN stop = 0 THEN 0 ELSE ends[stop] END + 700)) FROM p JOIN d USING (doc_id) WHERE stop < len(ends)) SELECT p.doc_id, piece, md5(text[start + 1 : stop]) AS digest FROM p JOIN documents d ON d.doc_id = p.doc_id WHERE piece >= 0")
def split_by_bytes(t: Tables) -> DataFrame:
    return evidence.byte_table(t.documents, 700).select("doc_id", "piece", F.md5("content").alias("digest"))


COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))"


@query(f"SELECT q.vec_id AS query_id, r.vec_id AS vec_id, round({COS}, 5) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, r.vec_id) <= 5")
def vector_topk(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), "embedding")
    return evidence.top_k(q, t.embeddings, "query_id", "vec_id", "embedding", 5).select("query_id", "vec_id", F.round("score", 5).alias("score"))


@query(f"SELECT query_id, vec_id, lang FROM (SELECT q.vec_id AS query_id, r.vec_id AS vec_id FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 AND r.label < 5 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, r.vec_id) <= 24) JOIN documents ON doc_id = vec_id")
def eligible_topk_then_join(t: Tables) -> DataFrame:
    """Eligibility lies below the top-k, the joins above it."""
    q = t.embeddings.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), "embedding")
    top = evidence.top_k(q, t.embeddings.where("label < 5"), "query_id", "vec_id", "embedding", 24)
    return top.join(t.documents.select(C("doc_id").alias("vec_id"), "lang"), "vec_id").select("query_id", "vec_id", "lang")


@query(f"SELECT q.vec_id AS query_id, r.vec_id AS vec_id, round({COS}, 5) AS score FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, r.vec_id) <= 5")
def vector_topk_by_index(t: Tables) -> DataFrame:
    """The rows of ``vector_topk`` through an index that visits only rings whose bound allows it."""
    index = VectorIndex(t.embeddings, "vec_id", "embedding", 64)
    q = t.embeddings.where("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), "embedding")
    return index.top_k(q, "query_id", 5).select("query_id", "vec_id", F.round("score", 5).alias("score"))


VERSIONS = "SELECT o_orderkey, o_custkey AS g, CASE WHEN o_orderkey % 5 > 0 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS d, CASE WHEN o_custkey % 3 = 0 THEN 'v1' ELSE o_orderstatus END AS v FROM orders"


@query(f"WITH x AS ({VERSIONS}), f AS (SELECT g, count(*) AS n, count(d) AS dated, count(DISTINCT v) AS names, max(d) FILTER (d <= DATE '1998-06-15') AS latest FROM x GROUP BY 1), c AS (SELECT g, d, count(*) AS same FROM x WHERE d IS NOT NULL GROUP BY 1, 2), j AS (SELECT x.*, f.n, f.dated, f.names, f.latest, l.same AS tie FROM x JOIN f USING (g) LEFT JOIN c l ON l.g = x.g AND l.d = f.latest) SELECT o_orderkey, coalesce(CASE WHEN n = 1 THEN d IS NULL OR d <= DATE '1998-06-15' WHEN dated < n THEN names = 1 AND (d IS NULL OR d <= DATE '1998-06-15') ELSE d = latest AND tie = 1 END, false) AS eligible, CASE WHEN n > 1 AND dated < n AND names > 1 THEN 'versions cannot be told apart' WHEN n > 1 AND dated = n AND tie > 1 THEN 'two versions of one day' END AS warning FROM j")
def version_as_of(t: Tables) -> DataFrame:
    day = F.when(C("o_orderkey") % 5 > 0, F.trunc(C("o_orderdate").cast("date"), "month"))
    version = F.when(C("o_custkey") % 3 == 0, "v1").otherwise(C("o_orderstatus"))
    return evidence.versions(t.orders, C("o_custkey"), "o_orderkey", day, version, F.lit("1998-06-15").cast("date")).select("o_orderkey", "eligible", "warning")


@query(f"WITH {ARTICLES}, p AS (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS after, length(line) + 1 AS size, CAST(i + 1 = k AS INT) AS last FROM x) SELECT doc_id, CAST(i AS INT) AS number, concat('제', i + 1, '조') AS key FROM p WHERE after - size < doc_id % 400 + 300 AND after - last > doc_id % 400")
def clauses_touched(t: Tables) -> DataFrame:
    hits = t.documents.select("doc_id", (C("doc_id") % 400).cast("int").alias("start"), (C("doc_id") % 400 + 300).cast("int").alias("end"))
    return evidence.overlapping(evidence.clause_table(laws(t)), hits).select("doc_id", "number", "key")


@query(f"WITH {ARTICLES}, p AS (SELECT doc_id, i, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS after, length(line) + 1 AS size, CAST(i + 1 = k AS INT) AS last FROM x), h AS (SELECT doc_id, CAST(unnest(range(doc_id % 100, length(text), 170)) AS INT) AS a FROM documents) SELECT doc_id, CAST(i AS INT) AS number, a AS hit FROM p JOIN h USING (doc_id) WHERE after - size < a + 90 AND after - last > a")
def clauses_under_many_hits(t: Tables) -> DataFrame:
    """Every clause that any of a document's hits touches; long documents have hundreds of both."""
    starts = F.sequence(C("doc_id") % 100, F.length("text").cast("long") - 1, F.lit(170).cast("long"))
    a = t.documents.where(F.length("text") > C("doc_id") % 100).select("doc_id", F.explode(starts).alias("at"))
    hits = a.select("doc_id", C("at").cast("int").alias("start")).select("doc_id", "start", (C("start") + 90).alias("end"), C("start").alias("hit"))
    return evidence.overlapping(evidence.clause_table(laws(t)), hits).select("doc_id", "number", "hit")


@query("WITH x AS (SELECT doc_id, k, unnest(range(k)) AS i FROM (SELECT doc_id, len(string_split(text, chr(10))) AS k FROM documents)) SELECT doc_id, CAST(i - 1 AS INT) AS number, CAST(i AS INT) AS back FROM x WHERE i % 11 = 6 UNION ALL SELECT doc_id, CAST(i + 1 AS INT), CAST(i AS INT) FROM x WHERE i % 11 = 6 AND i % 3 = 1 AND i + 1 < k")
def exception_backlinks(t: Tables) -> DataFrame:
    return evidence.backlinks(evidence.clause_table(laws(t)))


def parsed(t: Tables, n_laws: int = 300) -> tuple[DataFrame, DataFrame]:
    rows = laws(t, n_laws)
    clause_rows = stored(evidence.clause_table(rows), "clauses")
    bodies = clause_rows.join(rows, "doc_id").select("doc_id", "number", F.substring("text", C("start") + 1, C("end") - C("start")).alias("body"))
    return clause_rows, stored(bodies, "bodies")


@query(f"WITH {ARTICLES}, b AS (SELECT doc_id, i, concat(line, CASE WHEN i + 1 < k THEN chr(10) END) AS body FROM x), d AS (SELECT doc_id, regexp_extract_all(body, '[\"“]([^\"”]{{1,50}})[\"”]', 1) AS terms FROM b WHERE i = 0) SELECT doc_id, CAST(i AS INT) AS number, 0 AS \"by\" FROM b JOIN d USING (doc_id) WHERE i > 0 AND len(list_filter(terms, lambda q: contains(body, q))) > 0")
def definition_support(t: Tables) -> DataFrame:
    return evidence.definitions(*parsed(t)).select("doc_id", "number", "by")


#: Laws are cited over the whole table.
CITES_ALL = CITES.replace("% 300", "% (SELECT max(doc_id) + 1 FROM documents)")
#: The place of a cited key among articles that are numbered from 1.
PLACE = "try_cast(regexp_extract(ref, '^제([1-9][0-9]*)조$', 1) AS BIGINT)"


@query(f"WITH {CITES_ALL}, r AS (SELECT doc_id, i, CAST(NULL AS VARCHAR) AS law, unnest(internal) AS ref FROM c UNION ALL SELECT doc_id, i, q.law, q.ref FROM (SELECT doc_id, i, unnest(external) AS q FROM c)), t AS (SELECT concat('law ', CASE WHEN doc_id % 3 = 0 THEN doc_id - doc_id % 10 ELSE doc_id END) AS law, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1), own AS (SELECT r.*, CASE WHEN r.law IS NULL THEN doc_id WHEN n = 1 THEN first END AS aim FROM r LEFT JOIN t USING (law)), z AS (SELECT doc_id AS aim, max(k) AS k FROM x GROUP BY 1), p AS (SELECT own.*, CASE WHEN {PLACE} <= k THEN {PLACE} END AS place FROM own LEFT JOIN z USING (aim)) SELECT doc_id, CAST(i AS INT) AS number, law, ref, CASE WHEN place IS NOT NULL THEN aim END AS target, CAST(place - 1 AS INT) AS target_number, CASE WHEN law IS NOT NULL AND aim IS NULL THEN 'law not resolved' WHEN place IS NULL THEN 'clause missing' END AS warning FROM p")
def reference_resolution(t: Tables) -> DataFrame:
    """Laws are cited over the whole table; a title that several documents share isn't resolved."""
    n_laws = (t.documents.agg(F.max("doc_id")).first()[0] or 0) + 1
    c = evidence.clause_table(laws(t, n_laws))
    number = F.when(C("doc_id") % 3 == 0, C("doc_id") - C("doc_id") % 10).otherwise(C("doc_id"))
    titles = t.documents.select(F.concat(F.lit("law "), number.cast("string")).alias("law"), "doc_id")
    return evidence.resolved(evidence.edges(c), c, titles).select("doc_id", "number", "law", "ref", "target", "target_number", "warning")


@query()
def citation_walk(t: Tables) -> DataFrame:
    n_laws = (t.documents.agg(F.max("doc_id")).first()[0] or 0) + 1
    clause_rows, bodies = parsed(t, n_laws)
    titles = t.documents.select(F.concat(F.lit("law "), C("doc_id").cast("string")).alias("law"), "doc_id")
    seeds = t.documents.where("doc_id % 50 = 0").select(C("doc_id").alias("seed"), "doc_id", F.lit(4).alias("number"))
    out = evidence.walk(seeds.join(clause_rows.select("doc_id", "number"), ["doc_id", "number"], "left_semi").select("seed", "doc_id", "number"), clause_rows, bodies, titles)
    return out.select("seed", "complete", "n_clauses", "warnings", F.md5("content").alias("content"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, n_chars, sum(n_chars) FILTER (n_chars > 500) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE n_chars <= 500 OR used <= 8192")
def final_budget(t: Tables) -> DataFrame:
    """Long records share a budget in order; short ones always stay."""
    used = running_total(t.documents.select("source", "doc_id", "n_chars"), ["source"], [C("doc_id")], F.when(C("n_chars") > 500, C("n_chars")), "used")
    return used.where((C("n_chars") <= 500) | (C("used") <= 8192)).select("source", "doc_id")
