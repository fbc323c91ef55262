"""Queries over written records: sources and sinks read back, replies, points, checkpoints, lookups, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import hashing, text
from loomgraph.hooks import Hooks
from loomgraph.operators import bm25, dense, fusion, graph_build, graph_query, incremental, quality, sessions, summary, tasks
from loomgraph.plans import graph_queries, search as plans, search_queries, text_queries
from loomgraph.plans.registry import query, rounded, turns
from loomgraph.service import Service, resolve_topic
from loomgraph.sources import graphs, points, sessions as session_sources, snapshots, tables

MERGED, RENDERED = text_queries.MERGED, text_queries.RENDERED
TRIM = "trim({c}, ' ' || chr(9) || chr(10) || chr(13))"


def day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def written(df, label: str, **options) -> str:
    """The path of df's only column as text files."""
    path = tables.new_path(df.sparkSession, label)
    df.write.options(**options).text(path)
    return path


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_no, role, text AS content FROM conversations""")
def sessions_json(spark, place):
    """Conversations as JSON lines in either spelling, among blank and broken lines, read back."""
    talk = turns(spark, place).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "role", "content"))).alias("ts"))
    one = F.to_json(F.struct(F.col("session_id").cast("string").alias("id"), F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns")))
    other = F.to_json(F.struct(F.lit("").alias("id"), F.col("session_id").cast("string").alias("session_id"), F.transform("ts", lambda t: F.struct(t["role"].alias("role"), F.lit("").alias("content"), t["content"].alias("text"))).alias("messages")))
    lines = talk.select(F.when(F.col("session_id") % 2 == 0, one).otherwise(other).alias("value"))
    broken = spark.createDataFrame([('{"id": "x", "turns": [',), ("   ",), ("no json",)], "value string")
    return session_sources.sessions_from_json(spark, written(lines.unionByName(broken), "sessions"))[1].select("session_id", F.col("turn_no").cast("int").alias("turn_no"), "role", "content")


@query("""SELECT n_name AS session_id, 'root' AS type, CAST(0 AS INTEGER) AS turn_no, 'user' AS role, r_name AS content FROM nation JOIN region ON r_regionkey = n_regionkey""")
def sessions_json_array(spark, place):
    """Nations as sessions, those of a region in one file that is a JSON array; types and roles are left to the defaults."""
    both = tables.read(spark, place, "nation").join(tables.read(spark, place, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = both.groupBy("r_name").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("session_id"), F.array(F.struct(F.col("r_name").alias("text"))).alias("messages")))).alias("value"))
    path = tables.new_path(spark, "arrays")
    listed.withColumn("region", F.col("r_name")).select("value", "region").write.partitionBy("region").text(path)
    found, said = session_sources.sessions_from_json(spark, f"{path}/*", multiline=True)
    return said.join(found.select(F.col("id").alias("session_id"), "type"), "session_id").select("session_id", "type", F.col("turn_no").cast("int").alias("turn_no"), "role", "content")


TABLES_SQL = f"""m AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {TRIM.format(c='text')} ELSE text END AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM conversations WHERE conv_id % 5 <> 0),
 kept AS (SELECT * FROM m WHERE role <> 'user' OR content <> ''), good AS (SELECT conv_id FROM kept GROUP BY conv_id HAVING count(*) FILTER (role = 'user') >= 2)"""


@query(f"""WITH {TABLES_SQL} SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn_no AS INTEGER) AS turn_no, role, content, CAST(1 AS INTEGER) AS n_calls, 'run ' || role AS cmd FROM kept JOIN good USING (conv_id)""")
def sessions_tables(spark, place):
    """Conversations as the three raw tables: every fifth is a branch, texts stand in two parts, a tool part lies between."""
    t = turns(spark, place)
    session = t.select("session_id").distinct().select(F.col("session_id").cast("string").alias("id"), F.when(F.col("session_id") % 5 == 0, F.lit("p")).alias("parent_id"), F.lit("t").alias("title"), F.col("session_id").alias("time_created"))
    key = F.concat_ws("-", "session_id", F.lpad(F.col("turn_no").cast("string"), 9, "0"))
    message = t.select(key.alias("id"), F.col("session_id").cast("string").alias("session_id"), F.col("turn_no").cast("long").alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    said = t.select(key.alias("message_id"), F.lit(1).cast("long").alias("time_created"), F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("data"))
    reminder = t.where("role = 'user'").select(key.alias("message_id"), F.lit(3).cast("long").alias("time_created"), F.lit('{"type":"text","text":"<system-reminder>x</system-reminder>"}').alias("data"))
    tool = t.select(key.alias("message_id"), F.lit(2).cast("long").alias("time_created"), F.concat(F.lit('{"type":"tool","tool":"bash","state":{"status":"completed","input":{"command":"run '), "role", F.lit('"}}}')).alias("data"))
    _, found = session_sources.turns_from_tables(session, message, said.unionByName(tool).unionByName(reminder))
    return found.select("session_id", F.col("turn_no").cast("int").alias("turn_no"), "role", "content", F.size("tool_calls").alias("n_calls"), F.col("tool_calls")[0]["cmd"].alias("cmd"))


@query(f"WITH {MERGED} SELECT conv_id || '_c' || turn_index AS chunk_id, CAST(conv_id AS VARCHAR) AS session_id, turn_index, msg AS user_message, said AS assistant_messages, sha256({RENDERED}) AS text_sha256 FROM chunks")
def chunks_jsonl(spark, place):
    """Chunks written as JSON lines and read back, and rendered from what was read."""
    made = sessions.chunk_sessions(turns(spark, place)).withColumn("session_id", F.col("session_id").cast("string"))
    path = tables.new_path(spark, "chunks")
    graphs.write_rows(made.drop("cleaned_text"), path)
    back = session_sources.read_chunks(spark, path)
    return back.select("chunk_id", "session_id", "turn_index", "user_message", "assistant_messages", F.sha2(text.render_chunk("user_message", "assistant_messages", "tool_calls", "mcp_calls"), 256).alias("text_sha256"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS task_label FROM orders""")
def tasks_jsonl(spark, place):
    """Orders as tasks, every third once more further down: the last line of a task holds."""
    o = tables.read(spark, place, "orders")
    row = lambda label, n: o.select(F.col("o_orderkey").cast("string").alias("task_id"), F.col(label).alias("task_label"), F.lit(n).alias("n"), "o_orderkey")
    both = row("o_orderpriority", 0).unionByName(row("o_orderstatus", 1).where("o_orderkey % 3 = 0")).orderBy("n", "o_orderkey")
    return session_sources.read_tasks(spark, written(both.select(F.to_json(F.struct("task_id", "task_label")).alias("value")), "tasks")).select("task_id", "task_label")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS summary FROM part""")
def summaries_jsonl(spark, place):
    """Part names as summaries, sorted; empty ones further down do not count, later ones do."""
    p = tables.read(spark, place, "part")
    row = lambda c, n: p.select(F.col("p_partkey").cast("string").alias("chunk_id"), c.alias("summary"), F.lit(n).alias("n"))
    rows = row(F.col("p_name"), 0).unionByName(row(F.col("p_type"), 1).where("chunk_id % 2 = 0")).unionByName(row(F.lit(""), 2)).orderBy("n", "chunk_id")
    return session_sources.read_summaries(spark, written(rows.select(F.to_json(F.struct("chunk_id", "summary")).alias("value")), "summaries"))


@query("""SELECT DISTINCT 'p' || l_partkey AS entity, CAST(l_orderkey AS VARCHAR) AS task FROM lineitem""")
def entities_jsonl(spark, place):
    """Entities with their tasks as JSON lines, each line twice; the inverted index rebuilt from them."""
    items = tables.read(spark, place, "lineitem")
    rows = tables.deal(items.select(F.concat(F.lit("p"), "l_partkey").alias("name"), F.col("l_orderkey").cast("string").alias("task")), items.count(), "name").groupBy("name").agg(F.collect_list("task").alias("source_tasks"))
    lines = tables.cut(rows.select(F.to_json(F.struct("name", F.lit("file").alias("entity_type"), "source_tasks")).alias("value")), "lines")
    return session_sources.read_entities(spark, written(lines.unionByName(lines), "entities"))[1]


@query("""SELECT 'c' || o_custkey AS head, l_returnflag AS relation, 'p' || l_partkey AS tail, round(1 - l_discount, 6) AS confidence, CAST(l_orderkey AS VARCHAR) AS source_task_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def triples_jsonl(spark, place):
    rows = graph_queries.triples(spark, place).withColumn("source_task_id", F.col("source_task").cast("string")).drop("source_task")
    path = written(rows.select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.createDataFrame([("{",)], "value string")), "triples")
    return session_sources.read_triples(spark, path).select("head", "relation", "tail", rounded("confidence").alias("confidence"), "source_task_id")


HIER_TASKS = f"""{graph_queries.HIER}, ends AS (SELECT head AS name, head AS task FROM hier UNION SELECT tail, head FROM hier)"""


def hierarchy_graph(spark, place):
    edges = graph_queries.hierarchy(spark, place).select("head", F.lit("in").alias("relation"), "tail", F.lit(1.0).alias("weight"), F.col("head").alias("source_task"), F.lit("triple").alias("extraction_mode"))
    named = graph_build.mentions(edges)
    return graph_build.graph_of(named, graph_queries.identity(graph_build.entities(named)), edges)


@query(f"""WITH {HIER_TASKS} SELECT head, tail, (SELECT count(*) FROM ends WHERE name = head) AS head_tasks, (SELECT count(*) FROM ends WHERE name = tail) AS tail_tasks FROM hier""")
def node_link(spark, place):
    """The hierarchy written as one node-link document and read back."""
    path = tables.new_path(spark, "nodelink")
    graphs.write_node_link(hierarchy_graph(spark, place), path)
    g = graphs.read_node_link(spark, path)
    n = lambda c: g.nodes.select(F.col("name").alias(c), F.col("task_count").cast("long").alias(f"{c}_tasks"))
    return g.edges.select("head", "tail").join(n("head"), "head").join(n("tail"), "tail")


@query("""SELECT extraction_mode, n_edges, n_nodes FROM (VALUES ('entity', (SELECT count(*) FROM nation)), ('triple', (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier))) t(extraction_mode, n_edges), (SELECT (SELECT count(DISTINCT n_regionkey) FROM nation) + (SELECT count(*) FROM nation) AS n_nodes)""")
def graph_modes(spark, place):
    """A graph imported twice under one mode, then under another: edges are replaced by mode, nodes whole."""
    g = hierarchy_graph(spark, place)
    few = tables.cut(g.edges.where("head like 'n%'"), "edges")
    named = graph_build.mentions(few)
    path = tables.new_path(spark, "graph")
    for graph, mode in ((g, "triple"), (g, "triple"), (graph_build.graph_of(named, graph_queries.identity(graph_build.entities(named)), few), "entity")):
        graphs.write_graph(graph, path, mode)
    return spark.read.parquet(f"{path}/edges").groupBy("extraction_mode").agg(F.count("*").alias("n_edges")).crossJoin(spark.read.parquet(f"{path}/nodes").agg(F.count("*").alias("n_nodes")))


CANON = "CASE WHEN name LIKE 'c%' THEN 'c' || (CAST(substr(name, 2) AS BIGINT) - CAST(substr(name, 2) AS BIGINT) % 2) ELSE name END"
MERGED_NODES = f"""{graph_queries.TRI}, ends AS (SELECT head AS name, source_task AS task FROM tri UNION SELECT tail, source_task FROM tri), can AS (SELECT name, task, {CANON} AS canonical FROM ends)"""


@query(f"""WITH {MERGED_NODES} SELECT canonical AS name, CAST(count(DISTINCT task) AS INTEGER) AS task_count, coalesce(list_sort(list(DISTINCT name) FILTER (name <> canonical)), []) AS aliases FROM can GROUP BY canonical""")
def merged_nodes(spark, place):
    """Customers by twos merged into one entity: tasks counted once, the other name an alias."""
    return graph_queries.merged_graph(spark, place).nodes.select("name", "task_count", "aliases")


@query(f"""WITH {graph_queries.TRI}, e AS (SELECT {CANON.replace('name', 'head')} AS head, relation, tail, confidence FROM tri) SELECT head, relation, tail, count(*) AS n, round(sum(confidence), 6) AS weight FROM e GROUP BY head, relation, tail""")
def merged_edges(spark, place):
    return graph_queries.merged_graph(spark, place).edges.groupBy("head", "relation", "tail").agg(F.count("*").alias("n"), rounded(F.sum("weight")).alias("weight"))


@query(f"""WITH {MERGED_NODES}, t AS (SELECT DISTINCT name, canonical FROM can) SELECT name, canonical AS canonical_name, (SELECT count(DISTINCT task) FROM can c WHERE c.canonical = t.canonical) AS n_tasks FROM t""")
def entity_files(spark, place):
    """entities.json and entity_tasks.json of the merged graph, read back."""
    t, named, names, canonical = graph_queries.merged_names(spark, place)
    path = tables.new_path(spark, "entities")
    graphs.write_entities(graph_build.triple_graph(t, canonical, named, keep=True), names, canonical, path)
    counted = spark.read.schema("name string, task long").json(f"{path}/entity_tasks.json").groupBy(F.col("name").alias("canonical_name")).agg(F.count("*").alias("n_tasks"))
    return spark.read.schema("name string, canonical_name string").json(f"{path}/entities.json").join(counted, "canonical_name").select("name", "canonical_name", "n_tasks")


@query("""SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, label FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)""")
def point_lookup(spark, place):
    e = tables.read(spark, place, "embeddings")
    ids = tables.read(spark, place, "benchmark").select(F.col("item_id").alias("vec_id"))
    return points.lookup(points.scan(e, with_vectors=True), ids.unionByName(ids), "vec_id").select("vec_id", F.size("embedding").alias("dim"), "label")


@query("SELECT vec_id, label FROM embeddings")
def point_scan(spark, place):
    return points.scan(tables.read(spark, place, "embeddings"))


@query(r"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS body FROM documents), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}_]+')) AS t FROM c),
 k AS (SELECT doc_id, count(*) AS n_tokens, count(DISTINCT t) AS n_terms FROM w GROUP BY doc_id)
SELECT doc_id AS chunk, md5(CAST(doc_id AS VARCHAR)) AS point_key, coalesce(CAST(l.quality AS VARCHAR), '') AS task, coalesce(n_terms, 0) AS n_terms, coalesce(n_tokens, 0) AS n_tokens FROM c LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) LEFT JOIN k USING (doc_id) WHERE body <> ''""")
def chunk_points(spark, place):
    """Points of chunk summaries: every third has none and is skipped; those without a label have no task."""
    docs = tables.read(spark, place, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk"), F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.substring_index("text", "\n", 1)).alias("summary"))
    owners = tables.read(spark, place, "labels").select(F.col("doc_id").alias("chunk"), F.col("quality").alias("task"))
    made = points.chunk_points(chunks, owners, Hooks().embed)
    counts = F.map_values("sparse")
    return made.select("chunk", F.replace("point_id", F.lit("-"), F.lit("")).alias("point_key"), "task", F.coalesce(F.size("sparse"), F.lit(0)).cast("long").alias("n_terms"), F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_tokens"))


FINGER = "f AS (SELECT o_custkey AS session, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS bad FROM orders GROUP BY o_custkey)"


@query(f"""WITH {FINGER} SELECT session, session % 4 <> 0 AND session % 4 <> 1 AND bad = 0 AS done FROM f""")
def batch_decision(spark, place):
    """Customers as sessions of batches, against a checkpoint written and read back that lacks every fourth and has another mark for
    the next: done with the same mark and successes only."""
    o = tables.read(spark, place, "orders").select(F.col("o_custkey").alias("session"), F.when(F.col("o_orderstatus") == "O", "success").otherwise("failed").alias("status"))
    now = o.groupBy("session").agg(F.count("*").cast("string").alias("fingerprint"))
    path = tables.new_path(spark, "checkpoint")
    incremental.save_checkpoint(now.where("session % 4 <> 0").withColumn("fingerprint", F.when(F.col("session") % 4 == 1, "?").otherwise(F.col("fingerprint"))), path)
    return incremental.decide_batches(now, incremental.load_checkpoint(spark, path, "session long, fingerprint string"), o)


@query("""SELECT CAST(0 AS BIGINT) AS n_broken, CAST(0 AS BIGINT) AS n_missing, count(*) AS n_sound FROM customer""")
def corrupt_checkpoint(spark, place):
    """A checkpoint with a broken line counts as empty, and so does a missing one."""
    rows = tables.read(spark, place, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("session"), F.col("c_name").alias("fingerprint"))).alias("value"))
    read = lambda path: incremental.load_checkpoint(spark, path, "session long, fingerprint string").count()
    broken = rows.unionByName(spark.createDataFrame([('{"session": 1, "fing',)], "value string"))
    return spark.createDataFrame([(read(written(broken, "broken")), read(tables.new_path(spark, "missing")), read(written(rows, "sound")))], "n_broken long, n_missing long, n_sound long")


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_orderkey AS batch_id, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'failed' ELSE 'success' END AS status FROM orders JOIN n USING (o_custkey) WHERE NOT (n = 1 AND o_orderpriority LIKE '%URGENT%')""")
def rerun_surgery(spark, place):
    """Urgent orders are to be done again: sessions of one batch leave the checkpoint, other batches count as failed."""
    o = tables.read(spark, place, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n_batches"))
    batches = o.join(n, "o_custkey").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("batch_id"), "n_batches", F.col("o_orderpriority").alias("summary"), F.lit("success").alias("status"))
    return incremental.surgery(batches, incremental.rerun_plan(batches, F.contains("summary", F.lit("URGENT")))).select("batch_id", "status")


@query("""SELECT s_suppkey, s_name FROM supplier""")
def snapshot_restore(spark, place):
    """Suppliers in three snapshots, of which the last two are kept; the table dropped and brought back."""
    s, root, live = tables.read(spark, place, "supplier"), tables.new_path(spark, "snapshots"), tables.new_path(spark, "live")
    s.write.parquet(live)
    for name in ("a", "b"):
        snapshots.snapshot(spark.read.parquet(live).limit(1), root, name)
    snapshots.drop_table(spark, live, root, "c")
    if snapshots.keep_newest(spark, root, 2) != ["a"] or snapshots.names(spark, root) != ["b", "c"] or snapshots.exists(spark, live):
        raise AssertionError("snapshots are not what they should be")
    return snapshots.restore(spark, root, "c").select("s_suppkey", "s_name")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'run click' WHEN 'error' THEN 'mcp ' || event_id WHEN 'view' THEN '(unknown)' ELSE CASE WHEN event_id % 2 = 0 THEN 'act' ELSE 'at' END END AS summary FROM events""")
def tool_summaries(spark, place):
    """Events as calls: bash, MCP, one without anything, others by action or target."""
    e = F.col("event_type")
    even = F.col("event_id") % 2 == 0
    kind = F.when(e == "click", "bash").when(e == "error", "mcp_call").otherwise("tool_call")
    cmd = F.when(e == "click", F.lit("run click")).otherwise(F.lit(""))
    action = F.when(e == "error", "no").when((e != "view") & even, "act")
    target = F.when(e == "error", F.concat(F.lit("mcp "), "event_id")).when((e != "view") & ~even, "at")
    return tables.read(spark, place, "events").select("event_id", text.tool_summary(kind, cmd, action, target).alias("summary"))


TOK = "CAST(floor(length({c}) * 0.75) AS INTEGER)"


@query(f"""WITH {MERGED}, t AS (SELECT conv_id || '_c' || turn_index AS chunk_id, {RENDERED} AS whole, '[User]' || chr(10) || msg || chr(10) AS block, said, coalesce(list_aggregate(list_transform(said, lambda m: chr(10) || '[Assistant]' || chr(10) || m || chr(10)), 'string_agg', ''), '') AS joined FROM chunks),
 l AS (SELECT *, 400 - {TOK.format(c='block')} - 4 AS left_ FROM t), h AS (SELECT *, CAST(floor(left_ / 0.75) AS INTEGER) AS ch, CAST(floor(400 / 0.75) AS INTEGER) AS cb FROM l),
 cut AS (SELECT *, CASE WHEN {TOK.format(c='joined')} <= left_ THEN joined WHEN ch <= 21 THEN substr(joined, 1, ch) ELSE substr(joined, 1, least(CAST(floor(ch * CAST(0.7 AS DOUBLE)) AS INTEGER), greatest(ch - 21, 0))) || chr(10) || chr(10) || '[...TRUNCATED...]' || chr(10) || chr(10) || CASE WHEN ch - least(CAST(floor(ch * CAST(0.7 AS DOUBLE)) AS INTEGER), greatest(ch - 21, 0)) - 21 > 0 THEN right(joined, ch - least(CAST(floor(ch * CAST(0.7 AS DOUBLE)) AS INTEGER), greatest(ch - 21, 0)) - 21) ELSE '' END END AS shorter,
   CASE WHEN {TOK.format(c='block')} <= 400 THEN block ELSE substr(block, 1, CAST(floor(cb * CAST(0.7 AS DOUBLE)) AS INTEGER)) || chr(10) || chr(10) || '[...TRUNCATED...]' || chr(10) || chr(10) || right(block, cb - CAST(floor(cb * CAST(0.7 AS DOUBLE)) AS INTEGER) - 21) END AS alone FROM h)
SELECT chunk_id, CASE WHEN {TOK.format(c='whole')} <= 400 THEN 0 ELSE 4 END AS stage, sha256(CASE WHEN {TOK.format(c='whole')} <= 400 THEN whole WHEN left_ <= 0 THEN alone WHEN len(said) = 0 OR left_ <= 20 THEN block ELSE block || shorter END) AS text_sha256 FROM cut""")
def chunk_truncation(spark, place):
    """Chunks of conversations, which have no calls to drop, cut to 400 tokens."""
    cut = sessions.chunk_sessions(turns(spark, place)).select("chunk_id", text.truncate_chunk("user_message", "assistant_messages", "tool_calls", "mcp_calls", 400).alias("t"))
    return cut.select("chunk_id", "t.stage", F.sha2(F.col("t.text"), 256).alias("text_sha256"))


@query("""WITH c AS (SELECT event_id, event_type, (event_id % 3) AS n_bash, (event_id % 4) AS n_tool, (event_id % 2) AS n_mcp FROM events),
 r AS (SELECT *, '[User]' || chr(10) || event_type || chr(10) || chr(10) || '[Assistant]' || chr(10) || 'ok' || chr(10) AS body, repeat(chr(10) || '[Tool:bash] ls [OK]' || chr(10), n_bash) AS b, repeat(chr(10) || '[Tool:tool_call] edit [FAIL: no]' || chr(10), n_tool) AS t, repeat(chr(10) || '[MCP:mcp_call] docs [OK]' || chr(10), n_mcp) AS m FROM c),
 s AS (SELECT *, body || b || t || m AS s0, body || t || m || CASE WHEN n_bash > 0 THEN chr(10) || '[... ' || n_bash || ' tool/MCP calls omitted ...]' || chr(10) ELSE '' END AS s1, body || m || CASE WHEN n_bash + n_tool > 0 THEN chr(10) || '[... ' || (n_bash + n_tool) || ' tool/MCP calls omitted ...]' || chr(10) ELSE '' END AS s2, body || CASE WHEN n_bash + n_tool + n_mcp > 0 THEN chr(10) || '[... ' || (n_bash + n_tool + n_mcp) || ' tool/MCP calls omitted ...]' || chr(10) ELSE '' END AS s3 FROM r)
SELECT event_id, CASE WHEN floor(length(s0) * 0.75) <= 70 THEN 0 WHEN floor(length(s1) * 0.75) <= 70 THEN 1 WHEN floor(length(s2) * 0.75) <= 70 THEN 2 ELSE 3 END AS stage, CASE WHEN floor(length(s0) * 0.75) <= 70 THEN s0 WHEN floor(length(s1) * 0.75) <= 70 THEN s1 WHEN floor(length(s2) * 0.75) <= 70 THEN s2 ELSE s3 END AS text FROM s""")
def truncation_stages(spark, place):
    """Events as chunks with bash, tool and MCP calls, cut to 70 tokens: what goes first, and the notes of what went."""
    call = lambda kind, what, ok, error: F.struct(F.lit(kind).alias("type"), F.lit(what).alias("summary"), F.lit(ok).alias("ok"), F.lit(error).cast("string").alias("error"))
    e = F.col("event_id")
    times = lambda c, n: F.array_repeat(c, n.cast("int"))
    rows = tables.read(spark, place, "events").select("event_id", F.col("event_type").alias("u"), F.array(F.lit("ok")).alias("a"), F.concat(times(call("bash", "ls", True, None), e % 3), times(call("tool_call", "edit", False, "no"), e % 4)).alias("t"), times(call("mcp_call", "docs", True, None), e % 2).alias("m"))
    return rows.select("event_id", text.truncate_chunk("u", "a", "t", "m", 70).alias("x")).select("event_id", "x.stage", "x.text")


@query(f"""WITH {MERGED}, b AS (SELECT conv_id, (turn_index - 1) // 2 AS batch_id, turn_index, '--- c' || turn_index || ' ---' || chr(10) || {RENDERED} AS block FROM chunks),
 p AS (SELECT conv_id, batch_id, string_agg(block, chr(10) || chr(10) ORDER BY turn_index) AS prompt FROM b GROUP BY conv_id, batch_id) SELECT conv_id AS session_id, CAST(batch_id AS INTEGER) AS batch_id, sha256(prompt) AS prompt_sha256, {TOK.format(c='prompt')} AS tokens FROM p""")
def prompt_format(spark, place):
    """Chunks by twos as prompts."""
    chunks = sessions.chunk_sessions(turns(spark, place)).withColumn("batch_id", F.floor((F.col("turn_index") - 1) / 2).cast("int"))
    return tasks.format_prompts(chunks).select("session_id", "batch_id", F.sha2("prompt", 256).alias("prompt_sha256"), "tokens")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'ses_' || conv_id || '_c' || turn WHEN turn % 3 = 1 THEN conv_id || '_c' || turn ELSE conv_id || '_' || 'c' || turn END AS chunk_id, CASE WHEN turn % 3 = 0 THEN 'ses_' || conv_id ELSE CAST(conv_id AS VARCHAR) END AS session FROM conversations""")
def full_ids(spark, place):
    """Short, whole and foreign chunk ids completed, and their sessions read off them."""
    t = tables.read(spark, place, "conversations").select("conv_id", "turn")
    n = F.concat(F.lit("c"), "turn")
    given = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("ses_"), "conv_id", F.lit("_"), n)).when(F.col("turn") % 3 == 1, F.concat("conv_id", F.lit("_"), n)).otherwise(n)
    full = t.select("conv_id", "turn", text.full_chunk_id(given, F.col("conv_id").cast("string")).alias("chunk_id"))
    return full.withColumn("session", text.session_of_chunk("chunk_id"))


@query("""SELECT item_id, 'find: ' || text AS asked, text AS plain FROM benchmark""")
def retrieval_query(spark, place):
    return tables.read(spark, place, "benchmark").select("item_id", text.retrieval_query("text", "find: ").alias("asked"), text.retrieval_query("text").alias("plain"))


@query("""SELECT o_custkey AS session, sha256(string_agg(md5(o_orderpriority), '|' ORDER BY o_orderkey DESC) || '|') AS batch_hash FROM orders GROUP BY o_custkey""")
def batch_hash(spark, place):
    """The order of parts counts: orders from the last to the first."""
    o = tables.read(spark, place, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("o_orderkey", F.md5(F.col("o_orderpriority").cast("binary")).alias("h"))))), lambda x: x["h"]).alias("hs"))
    return o.select("session", hashing.ordered_hash(F.col("hs")).alias("batch_hash"))


@query("""WITH RECURSIVE d AS (SELECT doc_id // 40 AS s, list(CAST(floor(length(coalesce(text, '')) * 0.75) AS BIGINT) ORDER BY doc_id) AS ts, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY doc_id // 40),
 r(s, i, n, m) AS (SELECT s, 0, 0, 0 FROM d UNION ALL
   SELECT r.s, r.i + k.m, r.n + 1, k.m FROM r JOIN d USING (s), LATERAL (SELECT CAST(list_filter(list_transform([1, 2, 4, 8, 16], lambda h: CAST(ceil(least(16, len(d.ts) - r.i) / h) AS INTEGER)), lambda m: m = 1 OR list_sum(d.ts[r.i + 1:r.i + m]) + 250 * m <= 30000)[1] AS INTEGER) AS m) k WHERE r.i < len(d.ts))
SELECT CAST(r.s AS BIGINT) AS session_id, unnest(d.ids[r.i - r.m + 1:r.i]) AS turn_index, r.n AS batch_id FROM r JOIN d USING (s) WHERE r.n > 0""")
def batch_plan(spark, place):
    """Documents by forties as a session's chunks: enough text that batches are halved."""
    docs = tables.read(spark, place, "documents").select(F.floor(F.col("doc_id") / 40).alias("session_id"), F.col("doc_id").alias("turn_index"), text.count_tokens("text").alias("tokens"))
    return tasks.plan_batches(docs)


@query("""SELECT doc_id, '{"head":{"doc_id":' || doc_id || ',"lang":"' || lang || '"},"tail":["' || source || '","' || lang || '"]}' AS json FROM documents""")
def json_repair(spark, place):
    """Every document as a model's cut-off, fenced reply; the JSON that comes out."""
    reply = F.concat(F.lit("Here:\n```json\n"), F.substring_index(F.to_json(F.struct(F.struct("doc_id", "lang").alias("head"), F.array("source", "lang").alias("tail"))), "]", 1))
    return tables.read(spark, place, "documents").select("doc_id", tasks.extract_json_udf(reply).alias("json"))


@query("""SELECT o_orderkey AS task, CASE o_orderkey % 4 WHEN 0 THEN '{"n":' || o_orderkey || '}' WHEN 1 THEN '["a","b"]' WHEN 2 THEN '{"n":{"k":[1,2]}}' END AS json FROM orders""")
def json_extraction(spark, place):
    """Replies that are JSON, fenced, in the middle of words, and none at all."""
    k = F.col("o_orderkey") % 4
    reply = F.when(k == 0, F.concat(F.lit(' {"n": '), "o_orderkey", F.lit("}"))).when(k == 1, F.lit('Sure!\n```json\n["a", "b"]\n```\nDone.')).when(k == 2, F.lit('I say [x] and {"n": {"k": [1, 2]}} so.')).otherwise(F.lit("no idea"))
    return tables.read(spark, place, "orders").select(F.col("o_orderkey").alias("task"), tasks.extract_json_udf(reply).alias("json"))


@query("""WITH v AS (SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS n FROM lineitem), t AS (SELECT DISTINCT l_orderkey, n FROM v)
SELECT CAST(l_orderkey AS VARCHAR) AS session_id, 0 AS task_pos, l_orderkey || '_c' || n AS chunk_id FROM t WHERE n % 2 = 1 UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 1, l_orderkey || '_c' || n FROM t WHERE n % 2 = 0
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 1, NULL FROM t GROUP BY l_orderkey HAVING count(*) FILTER (n % 2 = 0) = 0 UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 0, NULL FROM t GROUP BY l_orderkey HAVING count(*) FILTER (n % 2 = 1) = 0""")
def task_replies(spark, place):
    """Replies with two tasks for every order: odd and even lines by short ids, and one id that no chunk has."""
    lines = tables.read(spark, place, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_linenumber").alias("n")).distinct()
    pick = lambda odd: F.concat(F.array_sort(F.collect_list(F.when(F.col("n") % 2 == odd, F.concat(F.lit("c"), "n")))), F.array(F.lit("c999")))
    replies = lines.groupBy("session_id").agg(F.to_json(F.struct(F.array(F.struct(F.lit("odd").alias("task_label"), pick(1).alias("chunk_ids")), F.struct(F.lit("even").alias("task_label"), pick(0).alias("chunk_ids"))).alias("tasks"))).alias("reply"))
    chunks = lines.select("session_id", F.concat_ws("_c", "session_id", "n").alias("chunk_id"))
    return tasks.validate_ids(tasks.parse_tasks(replies), chunks)[0].select("session_id", "task_pos", "chunk_id")


@query(f"""WITH {MERGED.replace(text_queries.GOOD + ',', '').replace(' JOIN good USING (conv_id)', '')}, c AS (SELECT conv_id, turn_index AS n, max(turn_index) OVER (PARTITION BY conv_id) AS m FROM chunks), o AS (SELECT *, m - (m + 1) % 2 AS last_odd FROM c)
SELECT conv_id AS session_id, CASE WHEN n % 2 = 1 THEN CASE WHEN n = last_odd THEN 0 ELSE 1 END WHEN n % 4 = 2 THEN 1 WHEN n + 1 = last_odd OR n - 1 = last_odd THEN 0 ELSE 1 END AS task_pos, conv_id || '_c' || n AS chunk_id FROM o""")
def ownership_repair(spark, place):
    """Chunks of each conversation, claimed by two tasks where their number is odd and by none where it is a multiple of four. An odd
    chunk lies nearer to the second task's even ones, until the first has no other; unclaimed ones go to the nearest."""
    chunks = sessions.merge_chunks(sessions.raw_chunks(turns(spark, place))).select("session_id", "chunk_id", "turn_index")
    n = F.col("turn_index")
    claims = chunks.select("session_id", "chunk_id", F.explode(F.when(n % 4 == 0, F.array().cast("array<int>")).when(n % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("task_pos"))
    return tasks.repair_ownership(claims, chunks)


@query("""SELECT round(avg(length(o_orderpriority)), 6) AS avg_label, round(avg(length(o_orderstatus)), 6) AS avg_summary, count(DISTINCT l_partkey) AS n_covered, count(l_partkey) - count(DISTINCT l_partkey) AS n_duplicate FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def extraction_quality(spark, place):
    rows = tables.read(spark, place, "lineitem").join(tables.read(spark, place, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("task_label"), F.col("o_orderstatus").alias("task_summary"), F.col("l_partkey").alias("chunk_id"))
    return tasks.quality(rows).select(rounded("avg_label").alias("avg_label"), rounded("avg_summary").alias("avg_summary"), "n_covered", "n_duplicate")


@query("""SELECT o_custkey AS session, o_orderkey AS batch_id, CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN 1 ELSE 2 END AS phase FROM orders""")
def batch_schedule(spark, place):
    return tasks.schedule(tables.read(spark, place, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("batch_id")))


@query("""SELECT o_orderkey AS task, CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 1 END AS attempts, CASE o_orderkey % 3 WHEN 0 THEN '{"ok":1}' WHEN 1 THEN '{"thought":1}' END AS reply, CASE WHEN o_orderkey % 3 = 2 THEN 'the reply is not valid' END AS error FROM orders""")
def model_replies(spark, place):
    """A model that answers, that answers in its reasoning only, and that never gives JSON."""

    def model(prompt: str):
        return ('{"ok":1}', {"content": "", "reasoning": '{"thought":1}'}, "well")[int(prompt) % 3]

    prompts = tables.read(spark, place, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_orderkey").cast("string").alias("prompt"))
    return tasks.call_model(prompts, model, attempts=2, wait=0.0).select("task", "attempts", "reply", "error")


@query("""WITH e AS (SELECT l_orderkey AS task, 'p' || l_partkey AS entity FROM lineitem) SELECT entity, task AS source_task FROM e""")
def entity_replies(spark, place):
    """Replies that list entities, as an object or bare, with blanks around names and generic words among them."""
    lines = tables.read(spark, place, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.concat(F.collect_list(F.concat(F.lit("  p"), "l_partkey", F.lit(" "))), F.array(F.lit("系统"), F.lit(" "), F.lit(""))).alias("es"))
    reply = F.when(F.col("task") % 2 == 0, F.to_json(F.struct(F.col("es").alias("entities")))).otherwise(F.concat(F.lit("```json\n"), F.to_json("es"), F.lit("\n```")))
    return tasks.parse_entities(lines.select("task", reply.alias("reply")))


@query("""SELECT 'p' || p_partkey AS a, 'q' || p_partkey AS b, p_partkey % 2 = 0 AS merge FROM part""")
def merge_replies(spark, place):
    """Confirmations in four forms: a list of pairs, an object of results, one action, a word."""
    a, b, yes = F.concat(F.lit("p"), "p_partkey"), F.concat(F.lit("q"), "p_partkey"), F.col("p_partkey") % 2 == 0
    item = F.array(F.struct(F.array(a, b).alias("pair"), F.when(yes, "merge").otherwise("keep").alias("action")))
    form = F.floor(F.col("p_partkey") / 2) % 4
    reply = F.when(form == 0, F.to_json(item)).when(form == 1, F.to_json(F.struct(item.alias("results")))).when(form == 2, F.concat(F.lit("So: "), F.to_json(F.struct(F.when(yes, "merge").otherwise("keep").alias("action"))))).otherwise(F.when(yes, "Yes, they are one.").otherwise("No."))
    return tasks.confirmations(tables.read(spark, place, "part").select(a.alias("a"), b.alias("b"), reply.alias("reply")))


@query("""SELECT DISTINCT p_name AS name, CASE WHEN length(p_name) % 2 = 0 THEN [1.0, 0.0] ELSE [0.0, CAST(length(p_name) AS DOUBLE)] END AS embedding FROM part""")
def embedding_cache(spark, place):
    """Names of even length have a vector in the cache; the others are embedded, once each."""
    names = tables.read(spark, place, "part").select(F.col("p_name").alias("name"))
    cache = names.where("length(name) % 2 = 0").distinct().select("name", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    return graph_build.embed_new(names, cache.unionByName(spark.createDataFrame([("unused", [1.0, 1.0])], "name string, embedding array<double>")), lambda c: F.array(F.lit(0.0), F.length(c).cast("double")))


@query(f"WITH {search_queries.bm25_sql('', 'documents', 'doc_id', 'text', 10)} SELECT {search_queries.HITS} FROM top")
def bm25_reloaded(spark, place):
    """The index written, loaded again, and asked with tokens."""
    path = tables.new_path(spark, "index")
    bm25.save(bm25.build(tables.read(spark, place, "documents")), path)
    asked = bm25.token_terms(search_queries._queries(spark, place).select("query_id", text.tokens("text").alias("tokens")))
    return search_queries.hits(bm25.best(bm25.load(spark, path), asked, 10))


@query(f"WITH {search_queries.dense_sql('d', 20, search_queries.HYBRID_Q, 'SELECT vec_id AS doc, embedding AS e FROM embeddings JOIN documents ON doc_id = vec_id')}, owned AS (SELECT doc_id, source FROM documents), rolled AS (SELECT query, source AS doc, max(score) AS score, row_number() OVER (PARTITION BY query ORDER BY round(max(score), 9) DESC, min(rank), source) AS rank FROM dtop JOIN owned ON doc_id = doc GROUP BY query, source) SELECT {search_queries.HITS} FROM rolled")
def summary_dense_topk(spark, place):
    """Chunks searched by their vectors instead of BM25, rolled up to tasks."""
    chunks = tables.read(spark, place, "documents").join(tables.read(spark, place, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select(F.col("doc_id").alias("chunk"), F.col("source").alias("task"), F.lit("has one").alias("summary"), "embedding")
    corpus = plans.Corpus(chunks, chunks, chunk_search="dense")
    found = plans.search_chunks(corpus, search_queries._hybrid_queries(spark, place), 20)
    return search_queries.hits(fusion.chunks_to_tasks(found, corpus.owners))


@query(f"""WITH {search_queries.bm25_sql('old_', 'documents', 'doc_id', 'text', 10)}, {search_queries.bm25_sql('new_', "(SELECT doc_id, text FROM documents WHERE lang <> 'en')", 'doc_id', 'text', 10)},
 s AS (SELECT query, doc, a.score AS old_score, b.score AS new_score FROM old_top a JOIN new_top b USING (query, doc) WHERE round(b.score - a.score, 9) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(new_score - old_score, 9) DESC, doc) AS n FROM s QUALIFY n <= 3)
SELECT query, doc, round(old_score, 6) AS old_score, round(new_score, 6) AS new_score, round(new_score - old_score, 6) AS shift FROM k""")
def score_shifts(spark, place):
    """How BM25 scores rise when the index leaves out one language."""
    docs, q = tables.read(spark, place, "documents"), search_queries._queries(spark, place)
    found = fusion.score_shifts(bm25.search(docs, q, 10), bm25.search(docs.where("lang <> 'en'"), q, 10), 3)
    return found.select("query", "doc", *[rounded(c).alias(c) for c in ("old_score", "new_score", "shift")])


@query("""SELECT 'documents' AS name, (SELECT count(*) FROM documents) AS n_rows, CAST(NULL AS INTEGER) AS dim UNION ALL SELECT 'embeddings', (SELECT count(*) FROM embeddings), (SELECT max(len(embedding)) FROM embeddings)""")
def collection_stats(spark, place):
    return quality.collection_stats(documents=tables.read(spark, place, "documents"), embeddings=tables.read(spark, place, "embeddings"))


@query("""SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_distinct FROM documents""")
def payload_sample(spark, place):
    """A drawn sample holds as many rows as asked for, none twice."""
    drawn = tables.cut(quality.sample_rows(tables.read(spark, place, "documents").select("doc_id"), 100, 42), "drawn")
    return drawn.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


@query("""SELECT fact, n FROM (VALUES ('chunks without a task', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))), ('drift', (SELECT count(*) FROM benchmark WHERE item_id % 2 = 0)), ('near pairs', (SELECT count(*) FROM part WHERE p_size > 40)), ('no hit', (SELECT count(*) FROM benchmark WHERE item_id % 3 = 0)), ('short summaries', (SELECT count(*) FROM documents WHERE length(text) < 50))) t(fact, n) WHERE n > 0""")
def inspection_facts(spark, place):
    """Only facts that hold are told."""
    b = tables.read(spark, place, "benchmark").select((F.col("item_id") % 2 == 0).alias("drift"), (F.col("item_id") % 3 != 0).alias("nominal"))
    docs = tables.read(spark, place, "documents")
    chunks = docs.join(tables.read(spark, place, "labels").select("doc_id", F.lit("t").alias("task")), "doc_id", "left")
    return quality.conclusions(b, tables.read(spark, place, "part").select((F.col("p_size") > 40).alias("is_near")), docs.withColumnRenamed("text", "summary"), chunks)


@query(f"""WITH {graph_queries.NODES} SELECT name, CAST(task_count AS INTEGER) AS task_count FROM nodes WHERE name IN ('c1', 'p3', 'c4')""")
def node_lookup(spark, place):
    return graph_query.get_nodes(graph_queries.graph(spark, place).nodes, ["c1", "p3", "c4", "unknown"]).select("name", "task_count")


@query(f"""WITH {graph_queries.NODES} SELECT task FROM ends WHERE name = 'p3'""")
def entity_tasks(spark, place):
    return graph_query.tasks_of(graph_queries.graph(spark, place), "p3")


def service(spark, place):
    g = graph_queries.graph(spark, place)
    t = tables.read(spark, place, "orders").select(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("session"), F.col("o_orderpriority").alias("label"), F.lit("").alias("summary"), day("o_orderdate").alias("created_at"))
    none = spark.createDataFrame([], "chunk long, task long, summary string, content string")
    return Service(plans.Corpus(t, none, chunk_search="dense"), g, graph_queries.categories(spark))


@query(f"""WITH {graph_queries.NODES} SELECT 'c1' AS name, (SELECT CAST(task_count AS INTEGER) FROM nodes WHERE name = 'c1') AS task_count, head, relation, tail, 'out' AS direction FROM tri WHERE head = 'c1'""")
def entity_info(spark, place):
    return service(spark, place).call("get_entity_info", name="c1").select("name", "task_count", "head", "relation", "tail", "direction")


@query("""SELECT o_orderkey AS task, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders WHERE o_custkey = 1""")
def session_tasks(spark, place):
    return service(spark, place).call("get_session_tasks", session=1).select("task", "created_at")


@query(f"""WITH {graph_queries.NODES} SELECT topic, name FROM (VALUES ('c1', 'c1'), ('about c4', 'c4'), ('zzz', NULL)) t(topic, name)""")
def topic_resolution(spark, place):
    """A topic that is a name, one with a word that is, and one that means nothing. The word is no part of a shorter name."""
    nodes = tables.cut(graph_queries.graph(spark, place).nodes.where("name in ('c1', 'c4', 'p3')"), "nodes")
    return spark.createDataFrame([(t, resolve_topic(nodes, t)) for t in ("c1", "about c4", "zzz")], "topic string, name string")


@query(f"""WITH {graph_queries.PARTS}, q AS (SELECT DISTINCT p_brand AS entity FROM part UNION SELECT 'Widget'), m AS (SELECT entity, name, task_count, p_brand, CASE WHEN lower(name) LIKE lower(entity) || '%' THEN 1 WHEN lower(p_brand) LIKE lower(entity) || '%' OR lower(p_type) LIKE lower(entity) || '%' THEN 2 WHEN contains(lower(name), lower(entity)) THEN 4 ELSE 5 END AS rank FROM q JOIN pn ON contains(lower(name), lower(entity)) OR contains(lower(p_brand), lower(entity)) OR contains(lower(p_type), lower(entity))),
 k AS (SELECT entity, name, row_number() OVER (PARTITION BY entity ORDER BY rank, length(name), task_count DESC, name) AS n FROM m QUALIFY n <= 3) SELECT DISTINCT entity AS query, name FROM k""")
def seed_resolution(spark, place):
    """Brands and a word as extracted names: none is a node, so each gives its three best fuzzy matches."""
    brands = tables.read(spark, place, "part").select(F.col("p_brand").alias("entity")).union(spark.createDataFrame([("Widget",)], "entity string")).distinct()
    return plans.resolve_seeds(graph_queries.part_nodes(spark, place), brands.select(F.col("entity").alias("query"), "entity"))


@query("""SELECT DISTINCT doc_id AS query, c_mktsegment AS entity FROM (SELECT DISTINCT c_mktsegment FROM customer UNION SELECT DISTINCT lang FROM documents) t(c_mktsegment) JOIN documents ON contains(lower(text), lower(c_mktsegment))""")
def query_entities(spark, place):
    """Whole documents as questions: the market segments and languages that stand in them, inside words too."""
    names = tables.read(spark, place, "customer").select(F.col("c_mktsegment").alias("name")).union(tables.read(spark, place, "documents").select("lang")).distinct()
    return plans.dictionary_entities(tables.read(spark, place, "documents").select(F.col("doc_id").alias("query"), "text"), names)


@query("""WITH t AS (SELECT o_orderkey AS task, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
 c AS (SELECT l_orderkey AS task, string_agg(p_name, chr(10) ORDER BY l_linenumber, l_partkey) AS content FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
 i AS (SELECT o_custkey, rank, content, CAST(floor(length(content) * 0.75) AS INTEGER) AS tokens FROM t JOIN c USING (task) WHERE rank <= 10 AND day >= '1994-01-01' AND day <= '1996-12-31'),
 r AS (SELECT *, sum(tokens) OVER (PARTITION BY o_custkey ORDER BY rank) AS run FROM i)
SELECT o_custkey AS query, CAST(rank AS INTEGER) AS rank, run > 300 AS truncated, CAST(CASE WHEN run > 300 THEN 300 - (run - tokens) ELSE tokens END AS BIGINT) AS used_tokens FROM r WHERE run <= 300 OR (run - tokens <= 300 AND 300 - (run - tokens) >= 200)""")
def summary_contents(spark, place):
    """What goes into a customer's summary: its first ten orders that lie in three years, part names as content, 300 tokens."""
    from pyspark.sql import Window

    o = tables.read(spark, place, "orders")
    lines = tables.read(spark, place, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("chunk_ids"))
    t = o.select(F.col("o_orderkey").alias("task"), day("o_orderdate").alias("created_at")).join(lines, "task")
    chunks = tables.read(spark, place, "part").select(F.col("p_partkey").alias("chunk"), F.col("p_name").alias("summary"), F.col("p_name").alias("content"))
    ranked = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"))
    return plans.summarize(ranked, t, chunks, budget=300, since="1994-01-01", until="1996-12-31").select("query", "rank", "truncated", F.col("used_tokens").cast("bigint").alias("used_tokens"))


@query("""WITH t AS (SELECT p_partkey % 7 AS page, p_name, p_brand, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) AS n FROM part) SELECT page, CAST(n AS INTEGER) AS row_no, p_brand AS value FROM t""")
def html_tables_rows(spark, place):
    """Parts in HTML tables on seven pages, each under a heading beside another table; one column read back by its header."""
    rows = tables.read(spark, place, "part").groupBy((F.col("p_partkey") % 7).alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_brand"))).alias("ps"))
    from loomgraph.sources import html_tables

    body = F.array_join(F.transform("ps", lambda p: F.concat(F.lit("<tr><td>"), p["p_name"], F.lit("</td><td> <b>"), p["p_brand"], F.lit("</b></td></tr>"))), "")
    page = F.concat(F.lit("<h2>Other</h2><table><tr><th>The Brand</th></tr><tr><td>no</td></tr></table><h2>List of parts</h2><table><tr><th>Name</th><th>The Brand</th></tr>"), body, F.lit("</table>"))
    found = html_tables.column_of(html_tables.read_tables(rows.select(F.col("page").alias("page_id"), page.alias("html"))), "parts", "TheBrand")
    return found.select(F.col("page_id").alias("page"), "row_no", "value")


@query("""SELECT l_orderkey AS session, CAST(l_linenumber AS INTEGER) AS chunk FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 <> 0)""")
def carried_over(spark, place):
    """Earlier rows of sessions that are done stay; those of sessions that are no longer there are orphans."""
    rows = tables.read(spark, place, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_linenumber").cast("int").alias("chunk"))
    decided = tables.read(spark, place, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("session"), (F.col("o_orderstatus") == "O").alias("done"))
    return incremental.carry_over(rows, decided)[0]


@query("""SELECT l_orderkey AS session, count(*) AS n FROM lineitem WHERE l_orderkey % 4 = 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""")
def orphan_rows(spark, place):
    rows = tables.read(spark, place, "lineitem").select(F.col("l_orderkey").alias("session"))
    decided = tables.read(spark, place, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("session"), F.lit(True).alias("done"))
    return incremental.carry_over(rows, decided)[1].groupBy("session").agg(F.count("*").alias("n"))
