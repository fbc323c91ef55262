"""Turns to chunks: a chunk begins at each user turn; chunks without an answer join the next one that has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import hashing, text

CHUNKER_VERSION = 1


def filter_sessions(turns: DataFrame, sessions: DataFrame | None = None, kind: str = "root", min_user: int = 2, session: str = "session_id") -> DataFrame:
    """Turns of the sessions with min_user user turns or more, and of one type where sessions are given."""
    good = turns.groupBy(session).agg(F.count_if(F.col("role") == "user").alias("n")).where(F.col("n") >= min_user).select(session)
    if sessions is not None:
        good = good.join(sessions.where(F.col("type") == kind).select(session), session, "left_semi")
    return turns.join(good, session, "left_semi")


def drop_blank_users(turns: DataFrame) -> DataFrame:
    """User turns cleaned of system reminders; those left blank go."""
    cleaned = turns.withColumn("content", F.when(F.col("role") == "user", text.clean_user_text("content")).otherwise(F.col("content")))
    return cleaned.where((F.col("role") != "user") | (F.coalesce("content", F.lit("")) != ""))


def raw_chunks(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, chunk_no, user_message, assistant_messages, calls, first_turn): turns before the first user turn go."""
    order = Window.partitionBy(session).orderBy("turn_no")
    calls = F.col("tool_calls") if "tool_calls" in turns.columns else F.lit(None).cast("array<struct<type:string,cmd:string,action:string,target:string,ok:boolean,output:string,error:string>>")
    output = F.col("output") if "output" in turns.columns else F.lit(None).cast("string")
    numbered = turns.select(session, "turn_no", "role", "content", calls.alias("tool_calls"), output.alias("output")).withColumn("chunk_no", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.when(F.col("role") == "assistant", F.nullif("content", F.lit(""))).when(F.col("role") == "tool_result", F.concat(F.lit("[Tool Result] "), F.nullif("output", F.lit(""))))
    item = F.struct("turn_no", said.alias("said"), F.when(F.col("role") == "assistant", F.col("tool_calls")).alias("calls"))
    grouped = numbered.where("chunk_no > 0").groupBy(session, "chunk_no").agg(
        F.max(F.when(F.col("role") == "user", F.coalesce("content", F.lit("")))).alias("user_message"), F.min("turn_no").alias("first_turn"), F.array_sort(F.collect_list(F.when(F.col("role") != "user", item))).alias("items")
    )
    return grouped.select(
        session,
        F.col("chunk_no").cast("int").alias("chunk_no"),
        "user_message",
        F.transform(F.filter("items", lambda x: x["said"].isNotNull()), lambda x: x["said"]).alias("assistant_messages"),
        F.flatten(F.transform(F.filter("items", lambda x: x["calls"].isNotNull()), lambda x: x["calls"])).alias("calls"),
        "first_turn",
    )


def merge_chunks(raw: DataFrame, session: str = "session_id") -> DataFrame:
    """Raw chunks without answers hand their message to the next chunk with one; the last ones form a chunk of their own.

    Within a merged run messages are stripped, a message equal to the one before it counts once, and blank lines join them.
    A chunk that nothing was merged into keeps its message as it is, and so does the only chunk of a session.
    """
    order = Window.partitionBy(session).orderBy("chunk_no")
    full = (F.size("assistant_messages") > 0) | (F.size("calls") > 0)
    marked = raw.withColumn("full", full).withColumn("grp", F.coalesce(F.sum(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy(session, "grp").orderBy("chunk_no")
    marked = marked.withColumn("bare", text.strip("user_message")).withColumn("same", F.coalesce(F.lag("bare").over(run) == F.col("bare"), F.lit(False)))
    last = F.struct(F.col("full").cast("int"), F.col("chunk_no"))
    merged = marked.groupBy(session, "grp").agg(
        F.count("*").alias("n"),
        F.max_by("user_message", last).alias("own"),
        F.bool_or("full").alias("any_full"),
        F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("chunk_no", "same", "bare"))), lambda x: ~x["same"]), lambda x: x["bare"]), "\n\n").alias("joined"),
        F.max_by("assistant_messages", last).alias("assistant_messages"),
        F.max_by("calls", last).alias("calls"),
        F.max_by("first_turn", last).alias("first_turn"),
    )
    alone = (F.col("n") == 1) & (F.col("any_full") | (F.count("*").over(Window.partitionBy(session)) == 1))
    number = F.row_number().over(Window.partitionBy(session).orderBy("grp"))
    return merged.withColumn("alone", alone).select(session, number.alias("turn_index"), F.concat(F.col(session).cast("string"), F.lit("_c"), number.cast("string")).alias("chunk_id"), F.when(F.col("alone"), F.col("own")).otherwise(F.col("joined")).alias("user_message"), "assistant_messages", "calls", "first_turn")


def clean_chunks(chunks: DataFrame, error_chars: int = 200) -> DataFrame:
    """Raw calls become summaries, split into tool_calls and mcp_calls; token sizes before and after; a content hash."""

    def brief(c: Column) -> Column:
        return F.struct(c["type"].alias("type"), text.tool_summary(c["type"], c["cmd"], c["action"], c["target"]).alias("summary"), F.coalesce(c["ok"], F.lit(True)).alias("ok"), F.when(c["ok"], F.lit(None)).otherwise(text.summarize_error(text.first_filled(c["error"]), error_chars)).alias("error"))

    raw = F.concat_ws("", "user_message", F.array_join("assistant_messages", ""), F.array_join(F.transform("calls", lambda c: F.concat_ws("", c["cmd"], c["action"], c["target"], c["output"], c["error"])), ""))
    split = chunks.withColumn("tool_calls", F.transform(F.filter("calls", lambda c: c["type"] != "mcp_call"), brief)).withColumn("mcp_calls", F.transform(F.filter("calls", lambda c: c["type"] == "mcp_call"), brief))
    sized = split.withColumn("raw_size_tokens", text.count_tokens(raw)).withColumn("cleaned_text", text.render_chunk("user_message", "assistant_messages", "tool_calls", "mcp_calls"))
    hashed = hashing.content_hash(**{c: F.col(c) for c in ("chunk_id", "user_message", "assistant_messages", "tool_calls", "mcp_calls")})
    return sized.withColumn("cleaned_size_tokens", text.count_tokens("cleaned_text")).withColumn("content_hash", hashed).drop("calls")


def chunk_sessions(turns: DataFrame, min_user: int = 2, session: str = "session_id") -> DataFrame:
    """The whole ingest: filter, chunk, merge, clean."""
    return clean_chunks(merge_chunks(raw_chunks(filter_sessions(drop_blank_users(turns), min_user=min_user, session=session), session), session))


def session_fingerprint(chunks: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, fingerprint): over the chunk hashes in the order of the chunk ids as strings."""
    return chunks.groupBy(session).agg(hashing.ordered_hash(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content_hash"))), lambda x: x["content_hash"])).alias("fingerprint"))


def turns_hash(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, turns_hash): over every turn in order."""
    one = F.sha2(F.to_json(F.struct("turn_no", "role", "content")), 256)
    return turns.withColumn("h", one).groupBy(session).agg(hashing.ordered_hash(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "h"))), lambda x: x["h"])).alias("turns_hash"))
