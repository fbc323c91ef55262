"""Ranking queries: BM25, dense, fusion, the composite searches, packing and inspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.hooks import Hooks
from loomgraph.operators import bm25, dense, fusion, quality, summary
from loomgraph.plans import search as plans
from loomgraph.plans.registry import query, rounded
from loomgraph.sources import tables

TOKENS = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


def bm25_sql(p: str, docs: str, doc: str, body: str, k: int, queries: str = "benchmark", query_id: str = "item_id", query_body: str = "text") -> str:
    """CTEs <p>idf(term, df, idf), <p>score(query, doc, score) and <p>top(query, doc, score, rank)."""
    return f"""
 {p}d AS MATERIALIZED (SELECT {doc} AS doc, {TOKENS.format(c=body)} AS w FROM {docs} WHERE len({TOKENS.format(c=body)}) > 0),
 {p}c AS MATERIALIZED (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {p}d),
 {p}p AS MATERIALIZED (SELECT doc, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc, w, unnest(w) AS term FROM {p}d) GROUP BY doc, len(w), term),
 {p}t AS MATERIALIZED (SELECT term, count(*) AS df FROM {p}p GROUP BY term),
 {p}r AS MATERIALIZED (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM {p}t, {p}c),
 {p}m AS MATERIALIZED (SELECT avg(raw) AS mean FROM {p}r),
 {p}idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM {p}r, {p}m),
 {p}q AS (SELECT query, term, count(*) AS times FROM (SELECT {query_id} AS query, unnest({TOKENS.format(c=query_body)}) AS term FROM {queries}) GROUP BY query, term),
 {p}score AS MATERIALIZED (SELECT query, doc, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {p}p JOIN {p}q USING (term) JOIN {p}idf USING (term), {p}c GROUP BY query, doc HAVING sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0),
 {p}top AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM {p}score QUALIFY rank <= {k})"""


def dense_sql(p: str, k: int, queries: str = "SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0", points: str = "SELECT vec_id AS doc, embedding AS e FROM embeddings") -> str:
    return f"""
 {p}s AS (SELECT q.query, p.doc, list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(p.e AS DOUBLE[])) AS score FROM ({queries}) q, ({points}) p),
 {p}top AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM {p}s QUALIFY rank <= {k})"""


def rrf_sql(out: str, a: str, b: str, k: int = 60, wa: str = "1.0", wb: str = "1.0") -> str:
    return f"""
 {out} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, first_rank NULLS LAST, second_rank NULLS LAST, doc) AS rank FROM (
   SELECT query, doc, coalesce({wa} / ({k} + a.rank), 0) + coalesce({wb} / ({k} + b.rank), 0) AS score, a.rank AS first_rank, b.rank AS second_rank FROM {a} a FULL JOIN {b} b USING (query, doc)))"""


def roll_sql(out: str, hits: str) -> str:
    return f"""
 {out} AS (SELECT query, source AS doc, max(score) AS score, row_number() OVER (PARTITION BY query ORDER BY round(max(score), 9) DESC, min(rank), source) AS rank FROM {hits} JOIN documents ON doc_id = doc GROUP BY query, source)"""


def _queries(spark, place):
    return tables.read(spark, place, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark, place, k):
    return bm25.search(tables.read(spark, place, "documents"), _queries(spark, place), k)


def _vector_queries(spark, place):
    return tables.read(spark, place, "embeddings").where("vec_id % 50 = 0")


def _dense(spark, place, k):
    return dense.search(tables.read(spark, place, "embeddings"), _vector_queries(spark, place), k, "vec_id", "vec_id")


HITS = "query, doc, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank"


def hits(df):
    return df.select("query", "doc", rounded("score").alias("score"), "rank")


@query(f"WITH {bm25_sql('', 'documents', 'doc_id', 'text', 10)} SELECT {HITS} FROM top")
def bm25_topk(spark, place):
    return hits(_bm25(spark, place, 10))


@query(f"WITH {bm25_sql('', 'documents', 'doc_id', 'text', 75)}, {roll_sql('rolled', 'top')} SELECT {HITS} FROM rolled WHERE rank <= 10")
def bm25_task_topk(spark, place):
    docs = tables.read(spark, place, "documents")
    owners = docs.select(F.col("doc_id").alias("chunk"), F.col("source").alias("task"))
    return hits(fusion.chunks_to_tasks(_bm25(spark, place, 75), owners).where("rank <= 10"))


@query(f"WITH {bm25_sql('', 'documents', 'doc_id', 'text', 1)} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, place):
    return bm25.term_idf(bm25.build(tables.read(spark, place, "documents"))).select("term", "df", rounded("idf").alias("idf"))


@query(f"""WITH {bm25_sql('', 'documents', 'doc_id', 'text', 1)}, best AS (SELECT term, max(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS best FROM p JOIN idf USING (term), c GROUP BY term)
SELECT term, round(greatest(coalesce(best, 0), 0), 6) AS idf_proxy FROM (SELECT DISTINCT term FROM q) LEFT JOIN best USING (term)""")
def token_idf_proxy(spark, place):
    terms = bm25.query_terms(_queries(spark, place)).select("term").distinct()
    return bm25.token_idf(bm25.build(tables.read(spark, place, "documents")), terms).select("term", rounded("idf_proxy").alias("idf_proxy"))


@query(f"WITH {dense_sql('', 10)} SELECT {HITS} FROM top")
def dense_topk(spark, place):
    return hits(_dense(spark, place, 10))


SPARSE = r"""w AS (SELECT doc_id AS doc, CAST(('0x' || substr(md5(term), 1, 7)) AS BIGINT) % 30000 AS token, max(n) AS weight FROM (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY doc_id, term) WHERE CAST(('0x' || substr(md5(term), 1, 7)) AS BIGINT) % 30000 > 3 GROUP BY doc_id, CAST(('0x' || substr(md5(term), 1, 7)) AS BIGINT) % 30000)"""


@query(f"""WITH {SPARSE}, s AS (SELECT q.doc AS query, p.doc, sum(p.weight * q.weight) AS score FROM w p JOIN w q USING (token) WHERE q.doc % 50 = 0 GROUP BY q.doc, p.doc),
 top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s QUALIFY rank <= 10) SELECT {HITS} FROM top""")
def sparse_vector_topk(spark, place):
    """A word's hash stands for its token id, its count for the weight; each id keeps its largest weight."""
    docs = tables.read(spark, place, "documents")
    queries = _token_weights(docs.where("doc_id % 50 = 0")).select(F.col("doc").alias("query"), "token", "weight")
    return hits(dense.sparse_search(_token_weights(docs), queries))


def _token_weights(docs):
    """(doc, token, weight): words are counted where they lie and dealt out once, by document."""
    words = tables.deal(bm25.counts(docs).select("doc", F.inline(F.arrays_zip("terms", "tfs"))), docs.count() * 500, "doc")
    terms = words.groupBy("doc", F.col("terms").alias("term")).agg(F.sum("tfs").cast("double").alias("weight"))
    return dense.max_pool(terms.select("doc", (F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 7), 16, 10).cast("long") % 30000).alias("token"), "weight"))


HYBRID_Q = "SELECT item_id AS query, embedding AS e FROM benchmark JOIN embeddings ON vec_id = item_id"


def _hybrid_queries(spark, place):
    e = tables.read(spark, place, "embeddings").select(F.col("vec_id").alias("query"), "embedding")
    return tables.read(spark, place, "benchmark").select(F.col("item_id").alias("query"), "text").join(e, "query")


FUSED = "query, doc, round(score, 9) AS score, CAST(first_rank AS INTEGER) AS first_rank, CAST(second_rank AS INTEGER) AS second_rank, CAST(rank AS INTEGER) AS rank"


def fused(df):
    return df.select("query", "doc", rounded("score", 9).alias("score"), "first_rank", "second_rank", "rank")


@query(f"WITH {dense_sql('d', 50, HYBRID_Q)}, {bm25_sql('s', 'documents', 'doc_id', 'text', 50)}, {rrf_sql('f', 'dtop', 'stop')} SELECT {FUSED} FROM f WHERE rank <= 10")
def hybrid_search(spark, place):
    q = _hybrid_queries(spark, place)
    near = dense.search(tables.read(spark, place, "embeddings"), q, 50, "vec_id", "query")
    return fused(fusion.rrf(near, bm25.search(tables.read(spark, place, "documents"), q, 50, query="query")).where("rank <= 10"))


@query(f"WITH {dense_sql('d', 50, HYBRID_Q)}, {bm25_sql('s', '(SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1)', 'doc_id', 'text', 50)}, {rrf_sql('f', 'dtop', 'stop')} SELECT {FUSED} FROM f WHERE rank <= 10")
def hybrid_cross_collection(spark, place):
    q = _hybrid_queries(spark, place)
    near = dense.search(tables.read(spark, place, "embeddings"), q, 50, "vec_id", "query")
    other = tables.read(spark, place, "documents").join(tables.read(spark, place, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return fused(fusion.rrf(near, bm25.search(other, q, 50, query="query")).where("rank <= 10"))


CENTRES = """cent AS (SELECT source AS doc, list(v ORDER BY i) AS e FROM (SELECT source, i, avg(x) AS v FROM (SELECT source, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM documents JOIN embeddings ON vec_id = doc_id) GROUP BY source, i) GROUP BY source)"""


def three_sql(n: int) -> str:
    """CTE f: the candidates of the three-way search, n of them wanted."""
    return f"""{CENTRES}, {dense_sql('d', n, HYBRID_Q, 'SELECT doc, e FROM cent')}, {bm25_sql('u', '(SELECT doc_id, split_part(text, chr(10), 1) AS summary FROM documents)', 'doc_id', 'summary', 3 * n)}, {roll_sql('utask', 'utop')},
     {bm25_sql('x', 'documents', 'doc_id', 'text', 3 * n)}, {roll_sql('xtask', 'xtop')}, {rrf_sql('inn', 'utask', 'xtask')}, {rrf_sql('f', 'dtop', 'inn')}"""


THREE = three_sql(25)


def corpus(spark, place, hooks: Hooks | None = None) -> plans.Corpus:
    """Sources as tasks, documents as chunks with their first line as summary; a task's vector is the mean of its documents'
    vectors, its summary that of its first document."""
    docs = tables.read(spark, place, "documents")
    vectors = tables.read(spark, place, "embeddings").withColumnRenamed("vec_id", "doc_id")
    item = docs.select("doc_id", "source").join(vectors, "doc_id").select("source", F.posexplode("embedding").alias("i", "x")).groupBy("source", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = item.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    line = F.substring_index("text", "\n", 1)
    first = docs.groupBy(F.col("source").alias("of")).agg(F.min("doc_id").alias("first"))
    # Few texts are compared: min_by() over all of them would sort them by source.
    listed = docs.join(tables.small(first), (F.col("source") == F.col("of")) & (F.col("doc_id") == F.col("first"))).groupBy("source").agg(F.min_by(line, "doc_id").alias("summary"))
    tasks = tables.cut(listed.join(centre, "source").select(F.col("source").alias("task"), F.col("source").alias("label"), "summary", F.lit("2024-01-01").alias("created_at"), "embedding"), "tasks")
    chunks = docs.select(F.col("doc_id").alias("chunk"), F.col("source").alias("task"), line.alias("summary"), F.col("text").alias("content"))
    return plans.Corpus(tasks, chunks, hooks or Hooks())


@query(f"WITH {THREE} SELECT {FUSED} FROM f WHERE rank <= 25")
def rrf_hierarchical(spark, place):
    return fused(plans.candidates(corpus(spark, place), _hybrid_queries(spark, place)))


@query(f"""WITH {THREE}, sm AS (SELECT source AS doc, arg_min(split_part(text, chr(10), 1), doc_id) AS summary FROM documents GROUP BY source),
 tok AS (SELECT query, doc, f.score AS hybrid, list_distinct({TOKENS.format(c='b.text')}) AS qt, list_distinct({TOKENS.format(c='summary')}) AS dt FROM f JOIN benchmark b ON b.item_id = query JOIN sm USING (doc) WHERE rank <= 25),
 rr AS (SELECT query, doc, hybrid, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, dt)) / len(qt) END AS score FROM tok)
SELECT query, doc, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, round(hybrid, 12) DESC, doc) AS rank FROM rr) WHERE rank <= 5""")
def session_search(spark, place):
    """The flagship: three-way retrieval, two-level fusion, reranking on the summary."""
    q, c = _hybrid_queries(spark, place), corpus(spark, place)
    return hits(plans.rerank(plans.candidates(c, q), q, c.tasks, c.hooks, 5))


@query(f"WITH {dense_sql('d', 20)}, g AS (SELECT query, doc, rank FROM (SELECT q.vec_id AS query, p.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY p.vec_id) AS rank FROM embeddings q JOIN embeddings p ON p.label = q.label WHERE q.vec_id % 50 = 0) WHERE rank <= 20), {rrf_sql('f', 'dtop', 'g', 30, '0.7', '0.3')} SELECT {FUSED} FROM f")
def graph_rag_fuse(spark, place):
    return fused(_weighted(spark, place))


def _weighted(spark, place):
    from pyspark.sql import Window

    e = tables.read(spark, place, "embeddings")
    q = _vector_queries(spark, place).select(F.col("vec_id").alias("query"), "label")
    graph = e.select(F.col("vec_id").alias("doc"), "label").join(tables.small(q), "label").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("doc"))).where("rank <= 20")
    return fusion.weighted_rrf(_dense(spark, place, 20), graph)


@query(f"WITH {dense_sql('d', 20)}, g AS (SELECT query, doc, rank FROM (SELECT q.vec_id AS query, p.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY p.vec_id) AS rank FROM embeddings q JOIN embeddings p ON p.label = q.label WHERE q.vec_id % 50 = 0) WHERE rank <= 20) SELECT CASE WHEN a.rank IS NOT NULL AND g.rank IS NOT NULL THEN 'both' WHEN g.rank IS NOT NULL THEN 'graph' ELSE 'vector' END AS source, count(*) AS n FROM dtop a FULL JOIN g USING (query, doc) GROUP BY 1")
def source_distribution(spark, place):
    return fusion.source_distribution(_weighted(spark, place))


@query(f"""WITH {dense_sql('d', 10)}, {dense_sql('n', 10, "SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0", "SELECT vec_id AS doc, embedding AS e FROM embeddings WHERE label <> 0")},
 j AS (SELECT query, rank, o.doc AS old_doc, n.doc AS new_doc FROM dtop o FULL JOIN ntop n USING (query, rank))
SELECT query, CAST(rank AS INTEGER) AS rank, old_doc, new_doc, coalesce(old_doc = new_doc, false) AS same, new_doc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dtop d WHERE d.query = j.query AND d.doc = new_doc) AS is_new, old_doc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ntop d WHERE d.query = j.query AND d.doc = old_doc) AS is_lost FROM j""")
def topk_diff(spark, place):
    other = tables.read(spark, place, "embeddings").where("label <> 0")
    return fusion.configuration_diff(_dense(spark, place, 10), dense.search(other, _vector_queries(spark, place), 10, "vec_id", "vec_id"))


@query("""WITH r AS (SELECT *, sum(tokens) OVER (PARTITION BY query ORDER BY rank) AS c FROM (SELECT lang AS query, doc_id AS rank, CAST(floor(length(coalesce(text, '')) * 0.75) AS INTEGER) AS tokens FROM documents)),
 k AS (SELECT *, c - tokens AS before FROM r)
SELECT query, rank, c > 12000 AS truncated, CAST(CASE WHEN c > 12000 THEN 12000 - before ELSE tokens END AS BIGINT) AS used_tokens FROM k WHERE c <= 12000 OR (before <= 12000 AND 12000 - before >= 200)""")
def budget_pack(spark, place):
    items = tables.read(spark, place, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("rank"), text.count_tokens("text").alias("tokens"))
    return summary.pack(items).select("query", "rank", "truncated", F.col("used_tokens").cast("bigint").alias("used_tokens"))


@query("""SELECT o_orderkey AS task, list(p_name ORDER BY l_linenumber, l_partkey) AS names FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def chunk_expand(spark, place):
    lines = tables.read(spark, place, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("chunk_ids"))
    chunks = tables.read(spark, place, "part").select(F.col("p_partkey").alias("chunk"), F.col("p_name").alias("content"))
    return summary.expand_chunks(lines, chunks).select("task", F.transform("chunks", lambda c: c["preview"]).alias("names"))


@query("""SELECT o_orderkey AS task, string_agg(p_name, chr(10) ORDER BY l_linenumber, l_partkey) AS content FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey""")
def chunk_content(spark, place):
    lines = tables.read(spark, place, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("chunk_ids"))
    chunks = tables.read(spark, place, "part").select(F.col("p_partkey").alias("chunk"), F.col("p_name").alias("summary"), F.col("p_name").alias("content"))
    return summary.chunk_content(lines, chunks, "full")


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT round(avg(n), 6) AS avg_size, CAST(min(n) AS INTEGER) AS min_size, CAST(max(n) AS INTEGER) AS max_size, CAST(sum(n) AS BIGINT) AS total FROM s""")
def chunks_per_task_stats(spark, place):
    lines = tables.read(spark, place, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("xs"))
    return quality.size_stats(lines, "xs").select(rounded("avg_size").alias("avg_size"), "min_size", "max_size", "total")


@query("""SELECT o_custkey AS session, count(*) AS n_tasks, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_at, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_at, list(o_orderpriority ORDER BY strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS labels FROM orders GROUP BY o_custkey""")
def list_sessions(spark, place):
    return summary.list_sessions(_order_tasks(spark, place), None)


def _order_tasks(spark, place):
    return tables.read(spark, place, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("task"), F.col("o_orderpriority").alias("label"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))


@query(f"WITH {dense_sql('d', 500000)} SELECT query AS a, doc AS b, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, score > 0.85 AS is_near FROM (SELECT query, doc, score, rank FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM (SELECT q.vec_id AS query, p.vec_id AS doc, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 10) q, embeddings p)) WHERE rank <= 4) WHERE query <> doc")
def neighbor_pairs(spark, place):
    """The report looks at the first ten tasks by definition."""
    out = quality.neighbours(tables.read(spark, place, "embeddings"), name="vec_id")
    return out.select("a", "b", rounded("score").alias("score"), "rank", "is_near")


@query(f"""WITH {bm25_sql('', 'documents', 'doc_id', 'text', 20)}, kw AS (SELECT item_id AS query, unnest(list_slice(list_distinct({TOKENS.format(c='text')}), 1, 1000)) AS word FROM benchmark),
 hit AS (SELECT t.query, t.rank, contains(lower(d.source || ' ' || d.lang), word) AS label, contains(lower(d.source || ' ' || d.lang), word) OR contains(lower(d.text), word) AS either FROM top t JOIN documents d ON d.doc_id = t.doc JOIN kw ON kw.query = t.query WHERE length(word) > 1),
 rate AS (SELECT query, bool_or(either AND rank <= 5) AS nominal, coalesce(min(rank) FILTER (label) <= 5, false) AS effective FROM hit GROUP BY query) SELECT query, nominal, effective, nominal AND NOT effective AS drift FROM rate""")
def retrieval_hit_rate(spark, place):
    docs = tables.read(spark, place, "documents")
    tasks = docs.select(F.col("doc_id").alias("doc"), F.concat_ws(" ", "source", "lang").alias("label"), F.col("text").alias("summary"))
    words = _queries(spark, place).select(F.col("query_id").alias("query"), F.explode(F.array_distinct(text.tokens("text"))).alias("word")).where("length(word) > 1")
    return quality.retrieval_hits(_bm25(spark, place, 20), tasks, words)
