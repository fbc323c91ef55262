"""Graph construction, graph queries, decision traces, skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph_build, graph_query, incremental, quality, summary
from loomgraph.plans import search as plans
from loomgraph.plans import search_queries
from loomgraph.plans.registry import query, rounded
from loomgraph.sources import tables

TRI = """tri AS (SELECT 'c' || o_custkey AS head, l_returnflag AS relation, 'p' || l_partkey AS tail, 1 - l_discount AS confidence, l_orderkey AS source_task, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
NODES = f"""{TRI}, ends AS (SELECT head AS name, source_task AS task FROM tri UNION SELECT tail, source_task FROM tri),
 nodes AS (SELECT name, count(DISTINCT task) AS task_count FROM ends GROUP BY name)"""
DEG = f"""{NODES}, deg AS (SELECT name, count(*) AS degree FROM (SELECT head AS name FROM tri UNION ALL SELECT tail FROM tri) GROUP BY name)"""


def triples(spark, place):
    """Orders as tasks: customer, return flag, part, with 1 - discount as confidence."""
    lines = tables.read(spark, place, "lineitem")
    n = lines.count()
    orders = tables.deal(tables.read(spark, place, "orders").select("o_orderkey", "o_custkey"), n, "o_orderkey")
    wanted = lines.select("l_orderkey", "l_returnflag", "l_partkey", "l_discount")
    return tables.deal(wanted, n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), "o_custkey").alias("head"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("p"), "l_partkey").alias("tail"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("source_task")
    )


def identity(names):
    return names.select("name", F.col("name").alias("canonical"))


def graph(spark, place):
    """Triples, tasks and edges are written once; what a query does not use of the nodes is not computed."""
    t = tables.cut(triples(spark, place), "triples")
    named = tables.cut(graph_build.mentions(t), "mentions")
    edges = t.select("head", "relation", "tail", F.col("confidence").alias("weight"), "source_task", F.lit("triple").alias("extraction_mode"))
    return graph_build.graph_of(named, identity(named.select("name").distinct()), edges)


def merged_graph(spark, place):
    """Customers by twos are one entity, named after the even one of them."""
    t, named, _, canonical = merged_names(spark, place)
    return graph_build.triple_graph(t, canonical, named)


def merged_names(spark, place):
    """The triples and their mentions, both written; the names and their canonical names."""
    t = tables.cut(triples(spark, place), "triples")
    named = tables.cut(graph_build.mentions(t), "mentions")
    names = tables.cut(graph_build.entities(named), "names")
    number = F.substring("name", 2, 20).cast("long")
    return t, named, names, names.select("name", F.when(F.col("name").startswith("c"), F.concat(F.lit("c"), number - number % 2)).otherwise(F.col("name")).alias("canonical"))


def hierarchy(spark, place):
    """Regions, nations, customers and suppliers as a tree of edges."""
    n, r, c, s = (tables.read(spark, place, t) for t in ("nation", "region", "customer", "supplier"))
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("head"), F.concat(F.lit("r"), "r_regionkey").alias("tail"))
    cust = c.select(F.concat(F.lit("c"), "c_custkey").alias("head"), F.concat(F.lit("n"), "c_nationkey").alias("tail"))
    supp = s.select(F.concat(F.lit("s"), "s_suppkey").alias("head"), F.concat(F.lit("n"), "s_nationkey").alias("tail"))
    return up.unionByName(cust).unionByName(supp)


HIER = """hier AS (SELECT 'n' || n_nationkey AS head, 'r' || n_regionkey AS tail FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
 near AS (SELECT head AS a, tail AS b FROM hier UNION SELECT tail, head FROM hier)"""


def part_nodes(spark, place):
    """Parts as entities: the brand and type are aliases, the orders their tasks."""
    part = tables.read(spark, place, "part")
    orders = tables.read(spark, place, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").cast("int").alias("task_count"))
    key = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    return part.join(orders, F.col("p_partkey") == F.col("l_partkey"), "left").select(key.alias("name"), F.array("p_brand", "p_type").alias("aliases"), F.coalesce("task_count", F.lit(0)).alias("task_count"))


PARTS = """pn AS (SELECT p_name || ' ' || p_partkey AS name, p_brand, p_type, coalesce(n, 0) AS task_count FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""


@query(f"""WITH {TRI} SELECT head, relation, tail, source_task, round(least(greatest(confidence, 0), 1), 6) AS confidence FROM tri""")
def triple_validity(spark, place):
    """Every triple, and as many with an empty, a generic or a null end, which go."""
    t = triples(spark, place)
    bad = t.withColumn("tail", F.when(F.col("source_task") % 3 == 0, F.lit("  ")).when(F.col("source_task") % 3 == 1, F.lit(" 系统 ")))
    padded = t.withColumn("head", F.concat(F.lit(" \t"), "head", F.lit("　 ")))
    return graph_build.clean_triples(padded.unionByName(bad)).select("head", "relation", "tail", "source_task", rounded("confidence").alias("confidence"))


@query("""SELECT l_partkey AS entity, l_orderkey AS task, min(l_linenumber) AS first_pos FROM lineitem GROUP BY l_partkey, l_orderkey""")
def inverted_index(spark, place):
    mentions = tables.read(spark, place, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("pos"))
    return graph_build.inverted_index(mentions)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.92""")
def align_pairs(spark, place):
    pairs = graph_build.similar_pairs(tables.read(spark, place, "embeddings"), name="vec_id")
    return pairs.select("a", "b", rounded("score").alias("score"))


@query("""SELECT 'doc' || doc_id AS name, first_value('doc' || doc_id) OVER (PARTITION BY text ORDER BY length('doc' || doc_id), 'doc' || doc_id) AS canonical FROM documents""")
def connected_components(spark, place):
    """Equal texts, linked each to the first of its group by name."""
    docs = tables.read(spark, place, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("name"), "doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("name").alias("b"))
    return graph_build.components(docs.join(first, "h").where("name <> b").select(F.col("name").alias("a"), "b"), docs)


@query(f"""WITH {NODES} SELECT name, CAST(task_count AS INTEGER) AS task_count, 'concept' AS entity_type FROM nodes""")
def triple_nodes(spark, place):
    return graph(spark, place).nodes.select("name", "task_count", "entity_type")


@query(f"""WITH {TRI} SELECT head, relation, tail, count(*) AS n, round(sum(confidence), 6) AS weight FROM tri GROUP BY head, relation, tail""")
def triple_edges(spark, place):
    return graph(spark, place).edges.groupBy("head", "relation", "tail").agg(F.count("*").alias("n"), rounded(F.sum("weight")).alias("weight"))


@query("""WITH f AS (SELECT l_orderkey AS task, l_partkey AS entity, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS n FROM lineitem GROUP BY l_orderkey, l_partkey)
SELECT a.entity AS head, b.entity AS tail, count(*) AS n_tasks, max(a.task) AS source_task, round(least(count(*) / 3, 1), 6) AS weight FROM f a JOIN f b ON a.task = b.task AND a.entity < b.entity AND a.n <= 15 AND b.n <= 15 GROUP BY a.entity, b.entity""")
def cooccurrence_edges(spark, place):
    mentions = tables.read(spark, place, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("pos"))
    return graph_build.cooccurrence(mentions).select("head", "tail", "n_tasks", "source_task", rounded("weight").alias("weight"))


@query(f"WITH {DEG} SELECT name, degree FROM deg ORDER BY degree DESC, name LIMIT 10")
def degree_topk(spark, place):
    return graph_build.degrees(graph(spark, place).edges).orderBy(F.desc("degree"), "name").limit(10)


@query(f"WITH {DEG} SELECT degree, count(*) AS n_nodes FROM deg GROUP BY degree")
def degree_histogram(spark, place):
    return graph_build.degree_histogram(graph(spark, place).edges)


@query(f"WITH {NODES} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM tri) AS n_edges, (SELECT count(*) FROM nodes) AS n_names, CAST(0 AS BIGINT) AS n_merged")
def kg_stats(spark, place):
    g = graph(spark, place)
    return graph_build.stats(g.nodes, g.edges, identity(g.nodes))


@query(f"""WITH {PARTS} SELECT name, CAST(rank AS INTEGER) AS rank, CAST(task_count AS INTEGER) AS task_count FROM (SELECT name, task_count, CASE WHEN name = 'widget' THEN 0 WHEN name ILIKE 'widget%' THEN 1 WHEN p_brand = 'widget' OR p_type = 'widget' THEN 2 WHEN p_brand ILIKE 'widget%' OR p_type ILIKE 'widget%' THEN 3 WHEN name ILIKE '%widget%' THEN 4 ELSE 5 END AS rank FROM pn WHERE name ILIKE '%widget%' OR p_brand ILIKE '%widget%' OR p_type ILIKE '%widget%') ORDER BY rank, length(name), task_count DESC, name LIMIT 20""")
def entity_search_ranked(spark, place):
    return graph_query.search_ranked(part_nodes(spark, place), "widget")


@query(f"""WITH {PARTS}, pick AS (SELECT lower(min(p_brand)) AS q FROM part) SELECT name, CAST(task_count AS INTEGER) AS task_count FROM pn, pick WHERE lower(name) = q OR lower(p_brand) = q OR lower(p_type) = q ORDER BY task_count DESC, name LIMIT 20""")
def entity_search_exact(spark, place):
    first = tables.read(spark, place, "part").agg(F.min("p_brand")).first()[0]
    return graph_query.search_exact(part_nodes(spark, place), first.upper())


@query(f"""WITH {TRI} SELECT head, relation, tail, source_task, 'out' AS direction FROM tri WHERE head = 'c1' UNION ALL SELECT head, relation, tail, source_task, 'in' FROM tri WHERE tail = 'c1'""")
def edges_both(spark, place):
    return graph_query.get_edges(graph(spark, place).edges, "c1").select("head", "relation", "tail", "source_task", "direction")


@query(f"""WITH RECURSIVE {HIER}, r(name, hop) AS (SELECT 'r2', 0 UNION SELECT b, hop + 1 FROM r JOIN near ON a = name WHERE hop < 3) SELECT name, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY name""")
def bfs_expand(spark, place):
    return graph_query.bfs(hierarchy(spark, place), spark.createDataFrame([("r2",)], "name string"), 3)


@query(f"""WITH RECURSIVE {NODES}, near AS (SELECT head AS a, tail AS b FROM tri UNION SELECT tail, head FROM tri), r1 AS (SELECT b AS name FROM near WHERE a = 'c1' ORDER BY b LIMIT 29), all1 AS (SELECT 'c1' AS name UNION SELECT name FROM r1),
 r2 AS (SELECT DISTINCT b AS name FROM near JOIN r1 ON a = r1.name WHERE b NOT IN (SELECT name FROM all1)), seen AS (SELECT name FROM all1 UNION (SELECT name FROM r2 ORDER BY name LIMIT (SELECT 30 - count(*) FROM all1)))
SELECT DISTINCT task FROM ends JOIN seen USING (name)""")
def query_kg(spark, place):
    orders = tables.read(spark, place, "orders").select(F.col("o_orderkey").alias("task"))
    return graph_query.query_kg(graph(spark, place), orders, "c1")


@query(f"WITH {NODES} SELECT name, CAST(task_count AS INTEGER) AS task_count FROM nodes ORDER BY task_count DESC, name LIMIT 10")
def top_entities(spark, place):
    return graph_query.top_entities(graph(spark, place).nodes).select("name", "task_count")


@query(f"WITH {NODES} SELECT (SELECT count(*) FROM nodes) AS n_nodes, round((SELECT avg(task_count) FROM nodes), 2) AS avg_task_count, (SELECT count(*) FROM tri) AS n_edges, CAST(1 AS BIGINT) AS n_modes")
def graph_stats(spark, place):
    g = graph(spark, place)
    return graph_query.stats(g.nodes, g.edges)


@query(f"WITH {DEG}, k AS (SELECT name FROM deg ORDER BY degree DESC, name LIMIT 500) SELECT head, relation, tail, source_task FROM tri WHERE head IN (SELECT name FROM k) AND tail IN (SELECT name FROM k)")
def prune_topn(spark, place):
    g = graph(spark, place)
    return graph_query.prune(g.nodes, g.edges)[1].select("head", "relation", "tail", "source_task")


@query("""SELECT p_name || ' ' || p_partkey AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def drop_isolates(spark, place):
    part = tables.read(spark, place, "part")
    nodes = part.select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), "p_partkey")
    edges = tables.read(spark, place, "lineitem").join(nodes, F.col("l_partkey") == F.col("p_partkey")).select(F.col("name").alias("head"), F.concat(F.lit("o"), "l_orderkey").alias("tail"))
    return graph_query.without_isolates(nodes.select("name"), edges)


@query(f"WITH {DEG} SELECT name, round(10 + 40 * degree / (SELECT max(degree) FROM deg), 6) AS size, CASE WHEN length(name) > 20 THEN substr(name, 1, 18) || '...' ELSE name END AS label FROM deg")
def visual_scale(spark, place):
    g = graph(spark, place)
    return graph_query.visual_scale(g.nodes, g.edges)[0].select("name", rounded("size").alias("size"), "label")


@query("SELECT 'concept' AS entity_type, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def type_histogram(spark, place):
    return graph_query.type_histogram(graph(spark, place).nodes)


@query(f"""WITH {NODES}, near AS (SELECT head AS a, tail AS b FROM tri UNION SELECT tail, head FROM tri), seen AS (SELECT 'c1' AS name UNION SELECT b FROM near WHERE a = 'c1'), n AS (SELECT greatest(count(*), 1) AS n FROM orders)
SELECT task, round(sum(ln(1 + n / greatest(task_count, 1))), 6) AS score FROM ends JOIN seen USING (name) JOIN nodes USING (name), n WHERE task IN (SELECT o_orderkey FROM orders) GROUP BY task ORDER BY round(sum(ln(1 + n / greatest(task_count, 1))), 9) DESC, task LIMIT 50""")
def anti_idf_scores(spark, place):
    g = graph(spark, place)
    around = graph_query.bfs(g.edges, spark.createDataFrame([("c1",)], "name string"), 1)
    orders = tables.read(spark, place, "orders").select(F.col("o_orderkey").alias("task"))
    return graph_query.anti_idf(g, around, orders).select("task", rounded("score").alias("score"))


CATS = "cats(relation, category) AS (VALUES ('R', 'excluded'), ('A', 'chosen'))"
STEPS = f"""{TRI}, {CATS}, near AS (SELECT head AS a, tail AS b FROM tri UNION SELECT tail, head FROM tri), seen AS (SELECT name, hop FROM (SELECT 'c1' AS name, 0 AS hop UNION SELECT b, 1 FROM near WHERE a = 'c1') ORDER BY hop, name LIMIT 50),
 st AS (SELECT head AS entity, tail AS related, relation, category, hop + 1 AS hop, 'out' AS direction, source_task, confidence AS weight FROM tri JOIN cats USING (relation) JOIN seen ON name = head
   UNION ALL SELECT tail, head, relation, category, hop + 1, 'in', source_task, confidence FROM tri JOIN cats USING (relation) JOIN seen ON name = tail),
 steps AS (SELECT *, row_number() OVER (PARTITION BY entity, related, relation, direction ORDER BY weight DESC, hop, source_task) AS n FROM st QUALIFY n = 1)"""


def categories(spark):
    return spark.createDataFrame([("R", "excluded"), ("A", "chosen")], "relation string, category string")


def steps(spark, place):
    return graph_query.trace(graph(spark, place).edges, categories(spark), "c1", 2)


@query(f"WITH {STEPS} SELECT entity, related, relation, category, CAST(hop AS INTEGER) AS hop, direction, source_task, round(weight, 6) AS weight FROM steps")
def trace_decision(spark, place):
    return steps(spark, place).select("entity", "related", "relation", "category", "hop", "direction", "source_task", rounded("weight").alias("weight"))


@query(f"WITH {STEPS}, ends AS (SELECT head AS name, source_task AS task FROM tri UNION SELECT tail, source_task FROM tri) SELECT source_task AS task FROM steps UNION SELECT task FROM ends WHERE name IN (SELECT entity FROM steps UNION SELECT related FROM steps)")
def related_tasks(spark, place):
    return graph_query.related_tasks(steps(spark, place), graph(spark, place))


@query(f"""WITH {STEPS}, f AS (SELECT *, row_number() OVER (ORDER BY hop, category, entity, related, relation, direction) AS k FROM steps QUALIFY k <= 20)
SELECT category, string_agg(CASE direction WHEN 'out' THEN entity || ' -> ' || relation || ' -> ' || related ELSE related || ' -> ' || relation || ' -> ' || entity END, chr(10) ORDER BY k) AS context FROM f GROUP BY category""")
def trace_context(spark, place):
    return summary.format_trace(steps(spark, place))


@query(f"""WITH {NODES}, near AS (SELECT head AS a, tail AS b FROM tri UNION SELECT tail, head FROM tri), seen AS (SELECT 'c1' AS name UNION SELECT b FROM near WHERE a = 'c1'), claims AS (SELECT DISTINCT name AS entity, task FROM ends JOIN seen USING (name))
SELECT entity, task FROM claims QUALIFY row_number() OVER (PARTITION BY task ORDER BY CASE WHEN entity = 'c1' THEN 0 ELSE 1 END, entity) = 1""")
def skeleton_sections(spark, place):
    g = graph(spark, place)
    around = graph_query.bfs(g.edges, spark.createDataFrame([("c1",)], "name string"), 1)
    claims = g.tasks.join(tables.small(around), "name").select(F.col("name").alias("entity"), "task")
    return summary.sections(claims, "c1")


@query(f"""WITH {STEPS},
 ends AS (SELECT head AS name, source_task AS task FROM tri UNION SELECT tail, source_task FROM tri), claims AS (SELECT DISTINCT name AS entity, task FROM ends WHERE name = 'c1' OR name IN (SELECT b FROM near WHERE a = 'c1' ORDER BY b LIMIT 29)),
 first AS (SELECT task FROM (SELECT DISTINCT task FROM claims) JOIN orders ON o_orderkey = task ORDER BY strftime(o_orderdate, '%Y-%m-%d'), task LIMIT 40),
 own AS (SELECT entity, task FROM claims WHERE task IN (SELECT task FROM first) QUALIFY row_number() OVER (PARTITION BY task ORDER BY CASE WHEN entity = 'c1' THEN 0 ELSE 1 END, entity) = 1),
 sec AS (SELECT entity, list(task ORDER BY strftime(o_orderdate, '%Y-%m-%d'), task) AS tasks FROM own JOIN orders ON o_orderkey = task GROUP BY entity),
 hin AS (SELECT entity, relation || ' ' || related AS t, row_number() OVER (PARTITION BY entity ORDER BY hop, category, related, relation, direction) AS k FROM steps QUALIFY k <= 5),
 told AS (SELECT entity, list(t ORDER BY k) AS hints FROM hin GROUP BY entity)
SELECT sec.entity, tasks, coalesce(hints, []) AS hints, '## ' || sec.entity || CASE WHEN sec.entity = 'c1' THEN ' (main)' ELSE '' END || chr(10) || array_to_string(list_transform(tasks, lambda t: '- ' || t) || list_transform(coalesce(hints, []), lambda h: '> ' || h), chr(10)) AS text FROM sec LEFT JOIN told ON told.entity = sec.entity""")
def skeleton_summary(spark, place):
    """The sections of one customer: its 40 first orders by date, each under the first entity that has it."""
    orders = tables.read(spark, place, "orders").select(F.col("o_orderkey").alias("task"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    found = tables.cut(plans.skeleton(graph(spark, place), categories(spark), "c1", depth=1, tasks=orders, limit=40, hops=2), "sections")
    return found.join(summary.format_skeleton(found, "c1"), "entity")


@query("""SELECT o_orderkey AS task FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def pending_tasks(spark, place):
    """Tasks without a triple of one relation are still to do."""
    done = tables.read(spark, place, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"))
    return tables.read(spark, place, "orders").select(F.col("o_orderkey").alias("task")).join(done, "task", "left_anti")


@query(f"""WITH {NODES}, near AS (SELECT head AS a, tail AS b FROM tri UNION SELECT tail, head FROM tri), seeds(name) AS (VALUES ('c1'), ('c2'), ('c4')), seen AS (SELECT name FROM seeds UNION SELECT b FROM near JOIN seeds ON a = name)
SELECT DISTINCT task FROM ends JOIN seen USING (name) ORDER BY task LIMIT 10""")
def context_tasks(spark, place):
    """Tasks around three entities, the first ten by name."""
    g = graph(spark, place)
    around = graph_query.bfs(g.edges, spark.createDataFrame([("c1",), ("c2",), ("c4",)], "name string"), 1)
    return g.tasks.join(around, "name", "left_semi").select("task").distinct().orderBy("task").limit(10)


@query("""WITH RECURSIVE d AS (SELECT 'n' || n_nationkey AS phase, 'r' || n_regionkey AS needs FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), r(name, hop) AS (SELECT 'r1', 0 UNION SELECT phase, hop + 1 FROM r JOIN d ON needs = name) SELECT name, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY name""")
def downstream_closure(spark, place):
    deps = hierarchy(spark, place).where("head not like 's%'").select(F.col("head").alias("phase"), F.col("tail").alias("needs"))
    return incremental.downstream(deps, spark.createDataFrame([("r1",)], "name string"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, row_number() OVER (ORDER BY n, conv_id) - 1 AS k, greatest(floor(count(*) OVER () / 10), 1) AS step FROM c) SELECT conv_id FROM r WHERE k % step = 0 AND k / step < 10""")
def select_sessions(spark, place):
    sizes = tables.read(spark, place, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return quality.every_nth(sizes, "conv_id", "n", 10).select("conv_id")


@query()
def alias_expand(spark, place):
    """Benchmark texts behind a part's brand: its entities' names and types join the query."""
    from loomgraph.operators import bm25

    nodes = part_nodes(spark, place)
    part = tables.read(spark, place, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    index = bm25.build(part.select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")))
    queries = tables.read(spark, place, "benchmark").join(part, F.col("item_id") == F.col("p_partkey")).select(F.col("item_id").alias("query"), F.concat_ws(" ", "p_name", "text").alias("text"))
    surface = nodes.withColumn("aliases", F.concat(F.col("aliases"), F.split("name", " ")))
    return plans.expand_query(index, surface, queries)


GRAPH_RAG = f"""WITH {search_queries.three_sql(80)}, pool AS (SELECT query, doc, rank FROM f WHERE rank <= 80),
 ge AS (SELECT DISTINCT source AS head, lang AS tail FROM documents), gt AS (SELECT head AS name, head AS task FROM ge UNION SELECT tail, head FROM ge),
 gn AS (SELECT name, count(*) AS task_count FROM gt GROUP BY name), seeds AS (SELECT DISTINCT query, name FROM ({search_queries.HYBRID_Q}) h JOIN benchmark ON item_id = query JOIN gn ON length(name) >= 2 AND contains(lower(text), lower(name))),
 nb AS (SELECT head AS a, tail AS b FROM ge UNION SELECT tail, head FROM ge), seen AS (SELECT query, name FROM seeds UNION SELECT query, b FROM seeds JOIN nb ON a = name), n AS (SELECT count(DISTINCT source) AS n FROM documents),
 gs AS (SELECT query, task AS doc, sum(ln(1 + n / task_count)) AS score FROM seen JOIN gn USING (name) JOIN gt USING (name), n GROUP BY query, task),
 gr AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM gs QUALIFY rank <= 50), {search_queries.rrf_sql('w', 'pool', 'gr', 30, '0.7', '0.3')},
 sm AS (SELECT source AS doc, arg_min(split_part(text, chr(10), 1), doc_id) AS summary FROM documents GROUP BY source),
 tok AS (SELECT query, doc, w.score AS hybrid, first_rank, second_rank, list_distinct({search_queries.TOKENS.format(c='b.text')}) AS qt, list_distinct({search_queries.TOKENS.format(c='summary')}) AS dt FROM w JOIN benchmark b ON b.item_id = query JOIN sm USING (doc) WHERE rank <= 16),
 rr AS (SELECT *, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, dt)) / len(qt) END AS score FROM tok)
SELECT query, doc, round(score, 6) AS score, round(hybrid, 9) AS hybrid_score, CAST(rank AS INTEGER) AS rank, CAST(first_rank AS INTEGER) AS first_rank, CAST(second_rank AS INTEGER) AS second_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, round(hybrid, 12) DESC, doc) AS rank FROM rr) WHERE rank <= 8"""


@query(GRAPH_RAG)
def graph_rag_search(spark, place):
    """Graph-RAG over sources for every query: entities are languages and sources, linked where a source has documents of a
    language. All of them together are fewer than the cap on nodes."""
    docs = tables.read(spark, place, "documents")
    edges = tables.cut(docs.select(F.col("source").alias("head"), F.lit("has").alias("relation"), F.col("lang").alias("tail"), F.lit(1.0).alias("weight"), F.col("source").alias("source_task")).distinct(), "edges")
    named = graph_build.mentions(edges)
    g = graph_build.graph_of(named, identity(graph_build.entities(named)), edges)
    queries = search_queries._hybrid_queries(spark, place)
    found = plans.graph_rag(search_queries.corpus(spark, place), g, queries)
    return found.select("query", "doc", rounded("score").alias("score"), rounded("hybrid_score", 9).alias("hybrid_score"), "rank", "first_rank", "second_rank")
