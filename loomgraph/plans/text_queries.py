"""Sessions, chunks, text and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import hashing, text
from loomgraph.operators import incremental, quality, sessions, tasks
from loomgraph.plans.registry import query, rounded, turns
from loomgraph.sources import sessions as session_sources, tables

GOOD = "good AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') >= 2)"
RAW = f"""{GOOD},
 numbered AS (SELECT c.*, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_no FROM conversations c JOIN good USING (conv_id)),
 raw AS (SELECT conv_id, chunk_no, max(text) FILTER (role = 'user') AS msg, coalesce(list(text ORDER BY turn) FILTER (role = 'assistant' AND text <> ''), []) AS said FROM numbered WHERE chunk_no > 0 GROUP BY conv_id, chunk_no)"""
MERGED = f"""{RAW},
 grp AS (SELECT *, coalesce(sum(CASE WHEN len(said) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g, count(*) OVER (PARTITION BY conv_id) AS of FROM raw),
 near AS (SELECT *, trim(msg, ' ' || chr(9) || chr(10) || chr(13)) AS bare, coalesce(lag(trim(msg, ' ' || chr(9) || chr(10) || chr(13))) OVER (PARTITION BY conv_id, g ORDER BY chunk_no) = trim(msg, ' ' || chr(9) || chr(10) || chr(13)), false) AS same FROM grp),
 merged AS (SELECT conv_id, g, CASE WHEN count(*) = 1 AND (max(len(said)) > 0 OR (SELECT count(*) FROM raw r WHERE r.conv_id = near.conv_id) = 1) THEN max(msg) ELSE string_agg(bare, chr(10) || chr(10) ORDER BY chunk_no) FILTER (NOT same) END AS msg, arg_max(said, (CASE WHEN len(said) > 0 THEN 1 ELSE 0 END, chunk_no)) AS said FROM near GROUP BY conv_id, g),
 chunks AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY g) AS INTEGER) AS turn_index, msg, said FROM merged)"""


@query(f"WITH {GOOD} SELECT conv_id AS session_id, count(*) AS n_turns FROM conversations JOIN good USING (conv_id) GROUP BY conv_id")
def session_filter(spark, place):
    return sessions.filter_sessions(turns(spark, place)).groupBy("session_id").agg(F.count("*").alias("n_turns"))


@query(f"WITH {RAW} SELECT conv_id AS session_id, CAST(chunk_no AS INTEGER) AS chunk_no, msg AS user_message, CAST(len(said) AS INTEGER) AS n_said FROM raw")
def chunk_turns(spark, place):
    raw = sessions.raw_chunks(sessions.filter_sessions(turns(spark, place)))
    return raw.select("session_id", "chunk_no", "user_message", F.size("assistant_messages").alias("n_said"))


@query(f"WITH {MERGED} SELECT conv_id AS session_id, turn_index, conv_id || '_c' || turn_index AS chunk_id, msg AS user_message, said AS assistant_messages FROM chunks")
def chunk_merge_dedupe(spark, place):
    merged = sessions.merge_chunks(sessions.raw_chunks(sessions.filter_sessions(turns(spark, place))))
    return merged.select("session_id", "turn_index", "chunk_id", "user_message", "assistant_messages")


RENDERED = "'[User]' || chr(10) || msg || chr(10) || coalesce(list_aggregate(list_transform(said, lambda m: chr(10) || '[Assistant]' || chr(10) || m || chr(10)), 'string_agg', ''), '')"


@query(f"WITH {MERGED}, t AS (SELECT conv_id || '_c' || turn_index AS chunk_id, {RENDERED} AS x FROM chunks) SELECT chunk_id, sha256(x) AS text_sha256, CAST(floor(length(x) * 0.75) AS INTEGER) AS tokens FROM t")
def chunk_render(spark, place):
    chunks = sessions.chunk_sessions(turns(spark, place))
    return chunks.select("chunk_id", F.sha2("cleaned_text", 256).alias("text_sha256"), F.col("cleaned_size_tokens").alias("tokens"))


@query("SELECT doc_id, CAST(floor(length(coalesce(text, '')) * 0.75) AS INTEGER) AS tokens FROM documents")
def token_counts(spark, place):
    return tables.read(spark, place, "documents").select("doc_id", text.count_tokens("text").alias("tokens"))


@query("""SELECT doc_id, CASE WHEN floor(length(text) * 0.75) <= 300 THEN text ELSE substr(text, 1, 280) || chr(10) || chr(10) || '[...TRUNCATED...]' || chr(10) || chr(10) || right(text, 99) END AS cut FROM documents""")
def text_truncate(spark, place):
    return tables.read(spark, place, "documents").select("doc_id", text.safe_truncate("text", 300).alias("cut"))


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '/run-' || role || ' ' || text WHEN 1 THEN '@src/' || role || ' ' || text WHEN 2 THEN '/a/b ' || text ELSE '<auto-slash-command> # /go-' || role || ' Command ' || text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN t WHEN turn % 4 = 3 THEN regexp_extract(t, '#\\s*(/[A-Za-z][\\w-]*)', 1) WHEN turn % 4 = 1 THEN regexp_extract(t, '^(@\\S+)', 1) ELSE regexp_extract(t, '^(/[A-Za-z][\\w-]*)(\\s|$)', 1) END AS folded FROM t""")
def collapse_command(spark, place):
    """Every turn's text behind each form of injected command, and behind a path, which stays."""
    kind, c = F.col("turn") % 4, F.col("text")
    t = F.when(kind == 0, F.concat(F.lit("/run-"), "role", F.lit(" "), c)).when(kind == 1, F.concat(F.lit("@src/"), "role", F.lit(" "), c)).when(kind == 2, F.concat(F.lit("/a/b "), c)).otherwise(F.concat(F.lit("<auto-slash-command> # /go-"), "role", F.lit(" Command "), c))
    return tables.read(spark, place, "conversations").withColumn("t", t).select("conv_id", "turn", text.collapse_command("t").alias("folded"))


@query("""SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS cleaned FROM conversations""")
def clean_user_text(spark, place):
    """Every turn with a reminder put before it, cleaned again."""
    said = F.concat(F.lit("<system-reminder>a\nb</system-reminder>\n"), "text")
    return tables.read(spark, place, "conversations").select("conv_id", "turn", text.clean_user_text(said).alias("cleaned"))


@query("""WITH t AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM conversations) SELECT conv_id, turn, CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '...[truncated, total ' || length(s) || ' chars]' ELSE s END AS error, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM t""")
def error_and_preview(spark, place):
    return tables.read(spark, place, "conversations").select("conv_id", "turn", text.summarize_error("text").alias("error"), text.preview("text").alias("preview"))


@query("""WITH h AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents) SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def stable_uuid(spark, place):
    return incremental.keyed(tables.read(spark, place, "documents").select("doc_id"), "doc_id").select("doc_id", "point_id")


@query("""SELECT doc_id, sha256(CAST(to_json({'lang': lang, 'source': source, 'text': text}) AS VARCHAR)) AS content_hash FROM documents""")
def content_hash(spark, place):
    return tables.read(spark, place, "documents").select("doc_id", hashing.content_hash(text=F.col("text"), lang=F.col("lang"), source=F.col("source")).alias("content_hash"))


@query(f"""WITH {MERGED}, h AS (SELECT conv_id, conv_id || '_c' || turn_index AS chunk_id, sha256({RENDERED}) AS h FROM chunks)
SELECT conv_id AS session_id, sha256(string_agg(h, '|' ORDER BY chunk_id) || '|') AS fingerprint FROM h GROUP BY conv_id""")
def session_fingerprint(spark, place):
    chunks = sessions.chunk_sessions(turns(spark, place)).withColumn("content_hash", F.sha2("cleaned_text", 256))
    return sessions.session_fingerprint(chunks)


@query("""SELECT conv_id AS session_id, sha256(string_agg(sha256(CAST(to_json({'turn_no': CAST(turn AS INTEGER), 'role': role, 'content': text}) AS VARCHAR)), '|' ORDER BY turn) || '|') AS turns_hash FROM conversations GROUP BY conv_id""")
def turns_hash(spark, place):
    return sessions.turns_hash(turns(spark, place))


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events""")
def json_field(spark, place):
    return tables.read(spark, place, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("""SELECT event_id, 'bash' AS type, 'run ' || event_type AS cmd, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE) = 0, false) AS ok FROM events""")
def tool_part(spark, place):
    """Each event as a stored tool part, parsed: its k is the exit code."""
    part = F.concat(F.lit('{"type":"tool","tool":"bash","state":{"status":"completed","input":{"command":"run '), "event_type", F.lit('"},"metadata":{"exit":'), F.get_json_object("props", "$.k"), F.lit("}}}"))
    call = session_sources.parse_tool_part(F.col("part"))
    return tables.read(spark, place, "events").withColumn("part", part).select("event_id", call.alias("c")).select("event_id", "c.type", "c.cmd", "c.ok")


@query("""SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12'""")
def time_range_filter(spark, place):
    rows = tables.read(spark, place, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return rows.where(text.in_time_range("at", "2024-01-05", "2024-01-12")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '\\.(py|js|ts|ya?ml|json|md|html|css)') THEN 'file' WHEN regexp_matches(lower(p_name), '\\b(bug|issue|error|fix)\\b') THEN 'bug' WHEN regexp_matches(lower(p_name), '\\b(tool|cli|command|api|sdk|framework)\\b') THEN 'tool' WHEN regexp_matches(lower(p_name), '\\b(project|repo|app|application)\\b') THEN 'project' WHEN regexp_matches(lower(p_name), '\\b(module|component|service|layer)\\b') THEN 'module' WHEN regexp_matches(p_name, '^[A-Z][a-z]+ [A-Z][a-z]+$') THEN 'person' ELSE 'concept' END AS entity_type FROM part""")
def entity_type(spark, place):
    return tables.read(spark, place, "part").select("p_partkey", text.entity_type("p_name").alias("entity_type"))


@query(f"""WITH {MERGED}, t AS (SELECT conv_id, floor(length({RENDERED}) * 0.75) AS n FROM chunks) SELECT conv_id AS session_id, count(*) AS n_chunks, CAST(sum(n) + 250 * count(*) AS BIGINT) AS total, sum(n) + 250 * count(*) > 30000 AS split FROM t GROUP BY conv_id""")
def needs_split(spark, place):
    chunks = sessions.chunk_sessions(turns(spark, place))
    return tasks.needs_split(chunks, tokens="cleaned_size_tokens").select("session_id", "n_chunks", F.col("total").cast("bigint").alias("total"), "split")


@query(f"""WITH {MERGED}, c AS (SELECT conv_id, count(*) AS n_items FROM chunks GROUP BY conv_id) SELECT n_items, count(*) AS n_keys FROM c GROUP BY n_items""")
def tasks_per_session_hist(spark, place):
    return quality.count_of_counts(sessions.chunk_sessions(turns(spark, place)), "session_id")


@query(f"""WITH {MERGED}, t AS (SELECT floor(length(msg || list_aggregate(said, 'string_agg', '')) * 0.75) AS raw, floor(length({RENDERED}) * 0.75) AS cleaned, len(said) > 0 AS has FROM chunks)
SELECT CAST(sum(coalesce(raw, 0)) AS BIGINT) AS raw_tokens, CAST(sum(cleaned) AS BIGINT) AS cleaned_tokens, round(sum(cleaned) / sum(coalesce(raw, 0)), 6) AS ratio, round(avg(CAST(has AS INTEGER)), 6) AS coverage, CAST(count(*) FILTER (NOT has) AS BIGINT) AS without_task FROM (SELECT CASE WHEN has THEN raw ELSE (SELECT NULL) END AS r0, raw, cleaned, has FROM t)""".replace("length(msg || list_aggregate(said, 'string_agg', ''))", "length(msg || coalesce(list_aggregate(said, 'string_agg', ''), ''))"))
def compression_ratio(spark, place):
    chunks = sessions.chunk_sessions(turns(spark, place))
    said = F.nullif(F.array_join("assistant_messages", ""), F.lit(""))
    out = quality.token_totals(chunks.withColumn("summary", said).withColumn("task", said))
    return out.select("raw_tokens", "cleaned_tokens", rounded("ratio").alias("ratio"), rounded("coverage").alias("coverage"), "without_task")


@query("""WITH c AS (SELECT conv_id, count(*) AS n, md5(string_agg(text, '' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id)
SELECT conv_id AS session_id, CASE conv_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'rechunked' ELSE 'reused' END AS decision FROM c""")
def checkpoint_diff(spark, place):
    """Fingerprints of all conversations against a checkpoint that lacks every fourth and has another mark for the next."""
    now = sessions.turns_hash(turns(spark, place))
    old = now.where("session_id % 4 <> 0").withColumn("turns_hash", F.when(F.col("session_id") % 4 == 1, F.lit("?")).otherwise(F.col("turns_hash"))).withColumn("chunker_version", F.lit(sessions.CHUNKER_VERSION))
    return incremental.decide(now, old, version=sessions.CHUNKER_VERSION)


@query("""SELECT o_custkey AS session, o_orderkey AS batch_id, md5(o_orderpriority) AS content_hash, o_orderstatus <> 'F' AS reuse FROM orders""")
def resume_batches(spark, place):
    orders = tables.read(spark, place, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("batch_id"), F.md5(F.col("o_orderpriority").cast("binary")).alias("content_hash"), "o_orderstatus")
    done = orders.withColumn("status", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success"))
    return incremental.resume_batches(orders.drop("o_orderstatus"), done)


@query("""SELECT p_partkey, CASE WHEN p_size < 20 THEN 'new ' || p_name ELSE p_name END AS p_name FROM part""")
def upsert_latest(spark, place):
    part = tables.read(spark, place, "part").select("p_partkey", "p_name", "p_size")
    return incremental.upsert(part.drop("p_size"), part.where("p_size < 20").select("p_partkey", F.concat(F.lit("new "), "p_name").alias("p_name")), "p_partkey")


@query("""SELECT DISTINCT o_custkey AS session, o_orderkey AS batch_id, count(*) OVER (PARTITION BY o_custkey) = 1 AS whole_session FROM orders QUALIFY contains(o_orderpriority, 'URGENT')""")
def rerun_plan(spark, place):
    orders = tables.read(spark, place, "orders")
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("n_batches"))
    batches = orders.join(n, "o_custkey").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("batch_id"), "n_batches", F.col("o_orderpriority").alias("summary"))
    return incremental.rerun_plan(batches, F.contains("summary", F.lit("URGENT")))


@query("""SELECT text AS key_text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_keys(spark, place):
    return quality.duplicate_keys(tables.read(spark, place, "documents").withColumnRenamed("text", "key_text"), "key_text")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'removed' ELSE 'changed' END AS change FROM documents WHERE doc_id % 5 < 3""")
def key_diff(spark, place):
    docs = tables.read(spark, place, "documents").select("doc_id", "lang")
    old = docs.where("doc_id % 5 <> 0")
    new = docs.where("doc_id % 5 <> 1").withColumn("lang", F.when(F.col("doc_id") % 5 == 2, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")))
    return quality.key_diff(old, new, "doc_id", "lang")


@query("""SELECT event_type AS model, count(*) AS n_runs, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(value), 6) AS avg_latency, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type""")
def model_rollup(spark, place):
    runs = tables.read(spark, place, "events").select(F.col("event_type").alias("model"), (F.col("value") > 10).alias("ok"), F.col("value").alias("latency"))
    return quality.model_rollup(runs).select("model", "n_runs", *[rounded(c).alias(c) for c in ("success_rate", "avg_latency", "p50", "p90")])


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'partial' ELSE 'success' END AS status, count(*) AS n, CAST(count(*) FILTER (o_orderpriority LIKE '1%') AS BIGINT) AS n_retried FROM orders GROUP BY 1""")
def status_rollup(spark, place):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "partial").otherwise("success")
    return tasks.status_rollup(tables.read(spark, place, "orders").select(status.alias("status"), F.when(F.col("o_orderpriority").startswith("1"), 2).otherwise(1).alias("attempts")))


@query("""WITH b AS (SELECT DISTINCT o_custkey AS session, o_orderkey AS batch_id, o_orderstatus = 'O' AS good FROM orders)
SELECT l_orderkey AS batch_id, l_linenumber AS pos, o_custkey || '_T' || row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS task_id FROM lineitem JOIN b ON b.batch_id = l_orderkey AND good JOIN orders ON o_orderkey = l_orderkey""".replace("ORDER BY l_orderkey, l_linenumber, l_partkey", "ORDER BY l_orderkey, l_linenumber"))
def merge_batches(spark, place):
    orders = tables.read(spark, place, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "O", "success").otherwise("failed").alias("status"), F.lit(1).alias("attempts"))
    lines = tables.read(spark, place, "lineitem").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("pos")).join(orders.select("session", "batch_id"), "batch_id")
    return tasks.merge_batches(lines, orders)[0].select("batch_id", "pos", "task_id")


@query("""SELECT lang AS name, round(avg(length(text)), 6) AS avg_length, CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length, CAST(count(*) FILTER (length(text) < 50) AS BIGINT) AS n_short FROM (SELECT 'all' AS lang, text FROM documents) GROUP BY lang""")
def summary_length_stats(spark, place):
    out = quality.length_stats(tables.read(spark, place, "documents"), "text", 50)
    return out.select(F.lit("all").alias("name"), rounded("avg_length").alias("avg_length"), "min_length", "max_length", "n_short")
