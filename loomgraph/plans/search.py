"""The composite searches: three-way retrieval with two-level fusion, and Graph-RAG on top of it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.hooks import Hooks
from loomgraph.operators import bm25, dense, fusion, graph_query, summary
from loomgraph.operators.graph_build import Graph
from loomgraph.sources import tables


@dataclass
class Corpus:
    """tasks(task, label, summary, created_at, chunk_ids, embedding), chunks(chunk, task, summary, content), and for dense search over
    chunks their embedding. chunk_ids are needed to expand tasks only. Both indexes are built once and kept."""

    tasks: DataFrame
    chunks: DataFrame
    hooks: Hooks = field(default_factory=Hooks)
    #: How chunks are searched: sparse (BM25) or dense.
    chunk_search: str = "sparse"

    def __post_init__(self):
        if self.chunk_search not in ("sparse", "dense"):
            raise ValueError("chunk_search is sparse or dense")
        if self.chunk_search == "sparse":
            self.summaries = bm25.build(self.chunks.where(F.coalesce("summary", F.lit("")) != ""), "chunk", "summary")
            self.contents = bm25.build(self.chunks, "chunk", "content")
        self.owners = self.chunks.select("chunk", "task")


def search_chunks(corpus: Corpus, queries: DataFrame, n: int, field_: str = "summaries") -> DataFrame:
    """The n best chunks of each query by the corpus' way of searching chunks: BM25 over summaries or contents, or dense over the
    vectors of chunks with a summary (or all)."""
    if corpus.chunk_search == "dense":
        chunks = corpus.chunks.where(F.coalesce("summary", F.lit("")) != "") if field_ == "summaries" else corpus.chunks
        return dense.search(chunks, queries, n, "chunk", "query")
    return bm25.best(getattr(corpus, field_), bm25.query_terms(queries, "query"), n)


def candidates(corpus: Corpus, queries: DataFrame, top_k: int = 5, multiplier: int = 5) -> DataFrame:
    """(query, doc, score, first_rank, second_rank, rank): n = top_k x multiplier tasks of each of queries(query, text, embedding).

    Dense over the tasks; BM25 over chunk summaries and over chunk texts, 3n chunks each, rolled up to tasks; the two chunk
    lists are fused first, then the dense list with that.
    """
    n = top_k * multiplier
    near = dense.search(corpus.tasks, queries, n, "task", "query")
    roll = lambda field_: fusion.chunks_to_tasks(search_chunks(corpus, queries, 3 * n, field_), corpus.owners, corpus.tasks)
    inner = fusion.rrf(roll("summaries"), roll("contents"))
    return fusion.rrf(near, inner).where(F.col("rank") <= n)


def rerank(found: DataFrame, queries: DataFrame, tasks: DataFrame, hooks: Hooks, top_k: int) -> DataFrame:
    """The top_k by the reranker's score on the task summary; the fused score stays as hybrid_score."""
    pairs = found.join(tables.small(queries.select("query", F.col("text").alias("_q"))), "query").join(tasks.select(F.col("task").alias("doc"), F.col("summary").alias("_s")), "doc")
    scored = pairs.withColumnRenamed("score", "hybrid_score").withColumn("score", hooks.rerank(F.col("_q"), F.col("_s")))
    order = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), F.round("hybrid_score", 12).desc(), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query", "doc", "score", "hybrid_score", "rank")


def search(corpus: Corpus, queries: DataFrame, top_k: int = 5, multiplier: int = 5, skip_rerank: bool = False) -> DataFrame:
    """Ranked tasks with their chunks. Without reranking all n candidates come back."""
    found = candidates(corpus, queries, top_k, multiplier)
    ranked = found.select("query", "doc", "score", F.col("score").alias("hybrid_score"), "rank") if skip_rerank else rerank(found, queries, corpus.tasks, corpus.hooks, top_k)
    tasks = corpus.tasks.select(F.col("task").alias("doc"), "label", "summary", "created_at")
    return ranked.join(tasks, "doc").join(summary.expand_chunks(corpus.tasks, corpus.chunks).withColumnRenamed("task", "doc"), "doc", "left")


def _grams(c):
    """The distinct lower-cased runs of one and of two characters: whatever contains a text has its first one."""
    chars = F.split(F.lower(c), "")
    return F.array_distinct(F.concat(chars, F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))))


def resolve_seeds(nodes: DataFrame, names: DataFrame, fuzzy: int = 3) -> DataFrame:
    """(query, name): the node of an extracted name, else its first fuzzy matches: nodes whose name or alias contains it, found by
    its first two characters. names(query, entity)."""
    exact = names.join(nodes.select("name"), F.col("entity") == F.col("name"), "left")
    low = F.lower("entity")
    loose = exact.where("name is null and entity <> ''").select("query", "entity", F.substring(low, 1, 2).alias("gram"))
    surfaces = nodes.select("name", "task_count", "aliases", F.explode(F.array_distinct(F.flatten(F.transform(F.concat(F.array("name"), "aliases"), _grams)))).alias("gram"))
    hit = surfaces.join(tables.small(loose), "gram").where(F.contains(F.lower("name"), low) | F.exists("aliases", lambda a: F.contains(F.lower(a), low)))
    rank = F.when(F.startswith(F.lower("name"), low), 1).when(F.exists("aliases", lambda a: F.startswith(F.lower(a), low)), 2).when(F.contains(F.lower("name"), low), 4).otherwise(5)
    order = Window.partitionBy("query", "entity").orderBy(rank, F.length("name"), F.desc("task_count"), "name")
    first = hit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fuzzy)
    return exact.where("name is not null").select("query", "name").union(first.select("query", "name")).distinct()


#: Names that are all held against every text; of more, only those whose first two characters a text has.
NAMES_EACH = 256


def dictionary_entities(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, entity): node names of two characters or more that stand in the query: the offline extractor. A text goes once past
    a few names; many are found by their first two characters, of which only those that some name has are looked for."""
    texts = queries.select("query", F.lower("text").alias("_t"))
    named = tables.cut(nodes.where(F.length("name") >= 2).select("name", F.lower("name").alias("low")).distinct(), "names")
    if named.limit(NAMES_EACH + 1).count() <= NAMES_EACH:
        met = tables.spread(texts).crossJoin(F.broadcast(named))
    else:
        begun = named.withColumn("gram", F.substring("low", 1, 2))
        first = tables.small(begun.select("gram").distinct())
        # The texts come to the pairs afterwards, by a row number, as ids of queries may repeat.
        asked = tables.cut(texts.withColumn("_row", F.monotonically_increasing_id()), "asked")
        grams = asked.select("_row", F.explode(_grams("_t")).alias("gram")).join(first, "gram")
        met = grams.join(tables.small(begun), "gram").select("_row", "name", "low").join(asked, "_row")
    return met.where(F.contains("_t", "low")).select("query", F.col("name").alias("entity")).distinct()


def graph_ranks(graph: Graph, tasks: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int = 30, limit: int = 50) -> DataFrame:
    """(query, doc, score, rank): tasks of the entities around the seeds of every query."""
    around = graph_query.bfs_each(graph.edges, seeds, depth, max_nodes)
    return graph_query.anti_idf_each(graph, around, tasks, limit)


def graph_rag(corpus: Corpus, graph: Graph, queries: DataFrame, top_k: int = 8, rerank_multiplier: float = 2.0, graph_weight: float = 0.3, k: int = 30) -> DataFrame:
    """Graph-RAG for all queries: the vector pool and the graph's tasks fused by weighted RRF, reranked, top_k."""
    if rerank_multiplier < 1:
        raise ValueError("rerank_multiplier is 1 or more")
    most = max(int(top_k * rerank_multiplier), top_k)
    pool = candidates(corpus, queries, most)
    seeds = resolve_seeds(graph.nodes, dictionary_entities(queries, graph.nodes))
    fused = tables.cut(fusion.weighted_rrf(pool, graph_ranks(graph, corpus.tasks, seeds), k, graph_weight), "fused")
    return rerank(fused.where(F.col("rank") <= most), queries, corpus.tasks, corpus.hooks, top_k).join(fused.select("query", "doc", "first_rank", "second_rank"), ["query", "doc"])


def summarize(ranked: DataFrame, tasks: DataFrame, chunks: DataFrame, level: str = "summary", budget: int = 12000, max_tasks: int = 10, since: str | None = None, until: str | None = None) -> DataFrame:
    """(query, doc, rank, used_tokens, truncated, content): what goes into a summary prompt, in rank order."""
    dated = ranked.join(tasks.select(F.col("task").alias("doc"), "created_at"), "doc").where(text.in_time_range("created_at", since, until)).where(F.col("rank") <= max_tasks)
    body = dated.join(summary.chunk_content(tasks, chunks, level).withColumnRenamed("task", "doc"), "doc")
    packed = summary.pack(body.withColumn("tokens", text.count_tokens("content")), budget)
    return packed.select("query", "doc", "rank", "used_tokens", "truncated", F.when(F.col("truncated"), text.safe_truncate("content", F.col("used_tokens"))).otherwise(F.col("content")).alias("content"))


def expand_query(index: bm25.Index, nodes: DataFrame, queries: DataFrame, max_tokens: int = 3, floor: float = 0.5, min_chars: int = 2, per_match: int = 2, most: int = 6, hits_each: int = 10) -> DataFrame:
    """(query, term): the query's own terms and those of aliases of the entities that its rarest terms name.

    Of each of the first terms by idf, each matching entity (by task count) offers its name and aliases without the term and
    without what is there already, per_match at most; once `most` surface terms are there no further match is taken, so the
    last one may go over. Surface terms are then tokenized again, each new token once.
    """
    own = queries.select("query", F.posexplode(text.tokens("text")).alias("pos", "term"))
    fit = own.where(F.length("term") >= min_chars).groupBy("query", "term").agg(F.min("pos").alias("pos"))
    proxy = bm25.token_idf(index, fit.select("term").distinct()).where(F.col("idf_proxy") >= floor)
    order = Window.partitionBy("query").orderBy(F.round("idf_proxy", 9).desc(), "pos")
    best = fit.join(tables.small(proxy), "term").withColumn("t", F.row_number().over(order)).where(F.col("t") <= max_tokens)
    names = nodes.select("name", "task_count", F.concat(F.array("name"), "aliases").alias("all")).withColumn("surface", F.explode("all"))
    hit = names.join(tables.small(best.select("query", "term", "t")), F.lower("surface") == F.col("term")).groupBy("query", "t", "term", "name", "task_count", "all").agg(F.lit(1))
    rank = Window.partitionBy("query", "t").orderBy(F.desc("task_count"), "name")
    hit = hit.withColumn("h", F.row_number().over(rank)).where(F.col("h") <= hits_each)
    offered = hit.select("query", "t", "h", "term", F.posexplode("all").alias("i", "surface")).where(F.lower("surface") != F.col("term")).join(own.select("query", F.col("term").alias("surface")).distinct(), ["query", "surface"], "left_anti")
    fresh = offered.withColumn("n", F.row_number().over(Window.partitionBy("query", "surface").orderBy("t", "h", "i"))).where("n = 1")
    few = fresh.withColumn("n", F.row_number().over(Window.partitionBy("query", "t", "h").orderBy("i"))).where(F.col("n") <= per_match)
    counted = few.groupBy("query", "t", "h").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("query").orderBy("t", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < most)
    extra = few.join(counted.select("query", "t", "h"), ["query", "t", "h"], "left_semi").select("query", F.explode(text.tokens("surface")).alias("term")).distinct()
    return own.select("query", "term").unionAll(extra.join(own.select("query", "term").distinct(), ["query", "term"], "left_anti"))


def skeleton(graph: Graph, categories: DataFrame, topic: str, depth: int = 2, max_nodes: int = 30, tasks: DataFrame | None = None, limit: int | None = None, hops: int = 3) -> DataFrame:
    """(entity, tasks, hints): the sections of a topic, each task under the first section that has it. With tasks(task, created_at) a
    section lists its tasks by time, and only the first `limit` tasks of all, by time, come in."""
    around = graph_query.bfs(graph.edges, graph.nodes.where(F.col("name") == topic).select("name"), depth, max_nodes)
    claims = graph.tasks.join(tables.small(around), "name").select(F.col("name").alias("entity"), "task")
    if tasks is not None and limit is not None:
        first = claims.select("task").distinct().join(tasks.select("task", "created_at"), "task").orderBy("created_at", "task").limit(limit).select("task")
        claims = claims.join(first, "task", "left_semi")
    return summary.section_hints(summary.sections(claims, topic), graph_query.trace(graph.edges, categories, topic, hops), tasks=tasks)
