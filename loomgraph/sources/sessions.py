"""Session sources: JSON files in several spellings, the three raw tables of a tool's database, mock data, saved chunks and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.sources import tables

CALL = "struct<type:string,cmd:string,command:string,action:string,description:string,target:string,resource:string,ok:boolean,success:boolean,output:string,result:string,error:string>"
TURN = f"struct<role:string,content:string,text:string,timestamp:string,created_at:string,tool_calls:array<{CALL}>,tool_call_id:string,output:string,result:string>"
SESSION = f"id string, session_id string, type string, created_at string, metadata map<string,string>, turns array<{TURN}>, messages array<{TURN}>, _corrupt_record string"
CHUNK = "chunk_id string, session_id string, turn_index int, user_message string, assistant_messages array<string>, tool_calls array<struct<type:string,summary:string,ok:boolean,error:string>>, mcp_calls array<struct<type:string,summary:string,ok:boolean,error:string>>, raw_size_tokens int, cleaned_size_tokens int, created_at string, task_summary string, content_hash string, _corrupt_record string"
TASK = "task_id string, session_id string, task_label string, task_summary string, chunk_ids array<string>, created_at string, _corrupt_record string"
SUMMARY = "chunk_id string, summary string, _corrupt_record string"
TRIPLE = "head string, relation string, tail string, confidence double, source_task_id string, _corrupt_record string"
ENTITY = "name string, entity_type string, canonical_name string, source_tasks array<string>, _corrupt_record string"


#: Where a line stands: by file, by the part of it that a task reads, then within the task.
PLACE = "_at"


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = False, placed: bool = False) -> DataFrame:
    """Rows of a file of JSON lines, or (multiline) of one array or object; blank and broken ones are skipped. placed adds a column that
    orders rows as they stand in the files."""
    lines = spark.read.option("wholetext", multiline).text(path)
    if placed:
        meta = F.col("_metadata")
        lines = lines.select("value", F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("part"), F.monotonically_increasing_id().alias("line")).alias(PLACE))
    if multiline:
        plain = schema.replace(", _corrupt_record string", "")
        return lines.select(F.explode(F.from_json("value", f"array<struct<{_colons(plain)}>>")).alias("r")).where("r is not null").select("r.*")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.where(F.trim("value") != "").select(parsed.alias("r"), *([PLACE] if placed else [])).where("r._corrupt_record is null").select("r.*", *([PLACE] if placed else [])).drop("_corrupt_record")


def _colons(schema: str) -> str:
    """name type, name type -> name:type,name:type (types hold no space)."""
    return ",".join(part.replace(" ", ":", 1) for part in schema.split(", "))


def _call(c: Column) -> Column:
    return F.struct(
        F.coalesce(text.first_filled(c["type"]), F.lit("tool_call")).alias("type"),
        text.first_filled(c["cmd"], c["command"]).alias("cmd"),
        text.first_filled(c["action"], c["description"]).alias("action"),
        text.first_filled(c["target"], c["resource"]).alias("target"),
        F.coalesce(c["ok"], c["success"], F.lit(True)).alias("ok"),
        text.first_filled(c["output"], c["result"]).alias("output"),
        c["error"].alias("error"),
    )


def sessions_from_json(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sessions, turns) of a file of sessions, one a line or (multiline) one array or object; alternative names are accepted, and an
    empty string counts as missing."""
    rows = read_json(spark, path, SESSION, multiline).withColumn("id", text.first_filled("id", "session_id"))
    sessions = rows.select("id", F.coalesce(text.first_filled("type"), F.lit("root")).alias("type"), "created_at", "metadata")
    turns = rows.select(F.col("id").alias("session_id"), F.posexplode(F.when(F.size("turns") > 0, F.col("turns")).otherwise(F.col("messages"))).alias("turn_no", "t"))
    return sessions, turns.select(
        "session_id",
        "turn_no",
        F.coalesce(text.first_filled("t.role"), F.lit("user")).alias("role"),
        F.coalesce(text.first_filled("t.content", "t.text"), F.lit("")).alias("content"),
        text.first_filled("t.timestamp", "t.created_at").alias("timestamp"),
        F.coalesce(F.transform("t.tool_calls", _call), F.array().cast("array<struct<type:string,cmd:string,action:string,target:string,ok:boolean,output:string,error:string>>")).alias("tool_calls"),
        "t.tool_call_id",
        text.first_filled("t.output", "t.result").alias("output"),
    )


def parse_tool_part(data: Column) -> Column:
    """A stored tool part (JSON text) as a tool call: ok by exit code, else by status; output cut to 2000 and errors to 500
    characters; anything but bash is named by tool and path."""
    get = lambda p: F.get_json_object(data, p)
    tool = F.coalesce(get("$.tool"), F.lit("unknown"))
    ok = F.when(get("$.state.metadata.exit").isNotNull(), get("$.state.metadata.exit").cast("double") == 0).otherwise(F.coalesce(get("$.state.status") == "completed", F.lit(False)))
    path = text.first_filled(get("$.state.input.filePath"), get("$.state.input.path"), get("$.state.input.file_path"))
    output = text.first_filled(get("$.state.output"))
    bash = tool == "bash"
    return F.struct(
        F.when(bash, "bash").otherwise("tool_call").alias("type"),
        F.when(bash, F.coalesce(get("$.state.input.command"), F.lit(""))).alias("cmd"),
        F.when(bash, F.coalesce(text.first_filled(get("$.state.input.description"), get("$.title")), F.lit(""))).when(path.isNotNull(), F.concat(tool, F.lit(": "), path)).otherwise(F.coalesce(text.first_filled(get("$.title")), tool)).alias("action"),
        F.when(~bash, path).alias("target"),
        ok.alias("ok"),
        F.substring(output, 1, 2000).alias("output"),
        F.when(~ok, F.substring(output, 1, 500)).alias("error"),
    )


def turns_from_tables(session: DataFrame, message: DataFrame, part: DataFrame, kind: str = "root", min_user: int = 2, limit: int | None = None, count_raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sessions, turns) of the raw tables session(id, parent_id, title, time_created), message(id, session_id, time_created, data) and
    part(message_id, time_created, data). kind: root, branch or all; the newest sessions first, `limit` of them if given.

    User turns left blank by cleaning go. A session needs min_user user turns, those that are left or (count_raw) all.
    """
    chosen = session.where({"root": "parent_id is null", "branch": "parent_id is not null", "all": "true"}[kind])
    if limit:
        chosen = chosen.orderBy(F.desc("time_created"), "id").limit(limit)
    messages = message.join(chosen.select(F.col("id").alias("session_id")), "session_id", "left_semi").select("session_id", F.col("id").alias("message_id"), "time_created", F.get_json_object("data", "$.role").alias("role"))
    kind_of = F.get_json_object("data", "$.type")
    parts = part.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("time_created", "data", kind_of.alias("kind")))).alias("ps"))
    said = F.array_join(F.filter(F.transform(F.filter("ps", lambda p: p["kind"] == "text"), lambda p: F.get_json_object(p["data"], "$.text")), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    calls = F.transform(F.filter("ps", lambda p: p["kind"] == "tool"), lambda p: parse_tool_part(p["data"]))
    order = Window.partitionBy("session_id").orderBy("time_created", "message_id")
    turns = messages.join(parts, "message_id", "left").select("session_id", (F.row_number().over(order) - 1).alias("turn_no"), "role", F.coalesce(said, F.lit("")).alias("raw"), calls.alias("tool_calls"), F.col("time_created").cast("string").alias("timestamp"))
    cleaned = turns.withColumn("content", F.when(F.col("role") == "user", text.clean_user_text("raw")).otherwise(F.col("raw")))
    left = cleaned.where((F.col("role") != "user") | (F.col("content") != ""))
    enough = (cleaned if count_raw else left).groupBy("session_id").agg(F.count_if(F.col("role") == "user").alias("n")).where(F.col("n") >= min_user).select("session_id")
    sessions = chosen.select("id", F.when(F.col("parent_id").isNull(), "root").otherwise("branch").alias("type"), F.col("time_created").cast("string").alias("created_at")).join(enough.select(F.col("session_id").alias("id")), "id", "left_semi")
    return sessions, left.join(enough, "session_id", "left_semi").drop("raw")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, CHUNK)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks; of rows with one task_id the last in the file holds."""
    rows = read_json(spark, path, TASK, placed=True)
    return rows.groupBy("task_id").agg(*[F.max_by(c, "_at").alias(c) for c in rows.columns if c not in ("task_id", "_at")])


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    rows = read_json(spark, path, SUMMARY, placed=True).where(F.coalesce("summary", F.lit("")) != "")
    return rows.groupBy("chunk_id").agg(F.max_by("summary", "_at").alias("summary"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, TRIPLE)


def read_entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, inverted index)."""
    rows = read_json(spark, path, ENTITY)
    listed = tables.cut(rows.select(F.col("name").alias("entity"), F.explode("source_tasks").alias("task")), "listed")
    return rows, tables.deal(listed, listed.count(), "entity", "task").distinct()


def mock_sessions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Three small sessions; the last has one user turn only."""
    call = lambda kind, **k: {"type": kind, "cmd": None, "action": None, "target": None, "ok": True, "output": None, "error": None} | k
    talk = {
        "mock_a": [("user", "List the files", []), ("assistant", "Here they are", [call("bash", cmd="ls")]), ("user", "Edit the reader", []), ("assistant", "Done, tests pass", [call("tool_call", action="edit", target="reader.py"), call("bash", cmd="pytest -q")])],
        "mock_b": [("user", "What is a chunk?", []), ("assistant", "A user turn and its answer", []), ("user", "Look it up", []), ("assistant", "Found", [call("bash", cmd="grep chunk"), call("mcp_call", target="docs", output="chunk: ...")])],
        "mock_c": [("user", "Hello", []), ("assistant", "Hello", [])],
    }
    rows = [(s, i, r, c, t) for s, ts in talk.items() for i, (r, c, t) in enumerate(ts)]
    turns = spark.createDataFrame(rows, "session_id string, turn_no int, role string, content string, tool_calls array<struct<type:string,cmd:string,action:string,target:string,ok:boolean,output:string,error:string>>")
    return spark.createDataFrame([(s, "root") for s in talk], "id string, type string"), turns


def source_of(sqlite: str | None = None, mock: bool = False, source: str | None = None, config: dict | None = None) -> tuple[str, str | None]:
    """Which source holds: database, mock, file, then the configuration's mock and file."""
    config = config or {}
    if sqlite:
        return "tables", sqlite
    if mock:
        return "mock", None
    if source:
        return "json", source
    return ("mock", None) if config.get("mock_data") else ("json", config.get("source"))
