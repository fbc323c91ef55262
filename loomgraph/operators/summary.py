"""Summaries under a token budget, section building, browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text


def pack(items: DataFrame, budget: int = 12000, least: int = 200, query: str = "query") -> DataFrame:
    """items(query, rank, tokens) that fit: whole while the running sum stays within the budget; the first one beyond it is
    cut to the remainder if that is `least` or more; nothing after it. Adds used_tokens and truncated."""
    order = Window.partitionBy(query).orderBy("rank")
    run = items.withColumn("_sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("_sum") - F.col("tokens")
    left = F.lit(budget) - before
    # tokens are not negative, so the running sum never falls back: the first item beyond is the only one with before <= budget.
    first_over = (F.col("_sum") > budget) & (before <= budget)
    run = run.withColumn("_n", F.sum(first_over.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = run.where((F.col("_sum") <= budget) | (first_over & (F.col("_n") == 1) & (left >= least)))
    return kept.withColumn("truncated", F.col("_sum") > budget).withColumn("used_tokens", F.when(F.col("_sum") > budget, left).otherwise(F.col("tokens"))).drop("_sum", "_n")


def chunk_content(tasks: DataFrame, chunks: DataFrame, level: str = "summary") -> DataFrame:
    """(task, content): the chunks of each task in order, as summary, preview (500 characters) or full text; missing chunks
    are skipped."""
    piece = {"summary": F.col("summary"), "preview": text.preview("content", 500), "full": F.col("content")}[level]
    rows = tasks.select("task", F.posexplode("chunk_ids").alias("pos", "chunk")).join(chunks.select("chunk", piece.alias("piece")), "chunk")
    return rows.groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "\n").alias("content"))


def expand_chunks(tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(task, chunks): the chunks of each task in order, as structs (pos, chunk, preview)."""
    rows = tasks.select("task", F.posexplode("chunk_ids").alias("pos", "chunk")).join(chunks.select("chunk", text.preview("content").alias("preview")), "chunk")
    return rows.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk", "preview"))).alias("chunks"))


def sections(claims: DataFrame, topic: str) -> DataFrame:
    """(entity, task) from claims(entity, task): the topic keeps all its tasks; the others, by spelling, take what no earlier
    section has."""
    order = Window.partitionBy("task").orderBy(F.when(F.col("entity") == topic, 0).otherwise(1), "entity")
    return claims.distinct().withColumn("n", F.row_number().over(order)).where("n = 1").select("entity", "task")


def section_hints(section_rows: DataFrame, steps: DataFrame, most: int = 5, tasks: DataFrame | None = None) -> DataFrame:
    """(entity, tasks, hints): each section with up to `most` decision hints, by hop and category; its tasks by name, or by the
    created_at of tasks(task, created_at) if given."""
    order = Window.partitionBy("entity").orderBy("hop", "category", "related", "relation", "direction")
    hints = steps.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    told = hints.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "relation", "related").alias("t")))), lambda x: x["t"]).alias("hints"))
    dated = section_rows.withColumn("created_at", F.lit("")) if tasks is None else section_rows.join(tasks.select("task", "created_at"), "task", "left")
    listed = dated.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "task"))), lambda x: x["task"]).alias("tasks"))
    return listed.join(told, "entity", "left").withColumn("hints", F.coalesce("hints", F.array().cast("array<string>")))


def format_skeleton(sections_: DataFrame, topic: str, trace: DataFrame | None = None) -> DataFrame:
    """(entity, text): a section as text, the topic's marked as the main one: tasks one a line, then hints."""
    head = F.concat(F.lit("## "), F.col("entity"), F.when(F.col("entity") == topic, F.lit(" (main)")).otherwise(F.lit("")))
    lines = F.concat(F.array(head), F.transform("tasks", lambda t: F.concat(F.lit("- "), t.cast("string"))), F.transform("hints", lambda h: F.concat(F.lit("> "), h)))
    return sections_.select("entity", F.array_join(lines, "\n").alias("text"))


def list_sessions(tasks: DataFrame, limit: int | None = 20) -> DataFrame:
    """(session, n_tasks, first_at, last_at, labels): the latest first; labels by time; empty times do not count."""
    at = F.nullif("created_at", F.lit(""))
    listed = tasks.groupBy("session").agg(F.count("*").alias("n_tasks"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.transform(F.array_sort(F.collect_list(F.struct("created_at", "task", "label"))), lambda x: x["label"]).alias("labels"))
    ordered = listed.orderBy(F.col("last_at").desc_nulls_last(), "session")
    return ordered.limit(limit) if limit else ordered


def session_tasks(tasks: DataFrame, session) -> DataFrame:
    return tasks.where(F.col("session") == session).orderBy("created_at", "task")


def format_trace(steps: DataFrame, max_steps: int = 20) -> DataFrame:
    """(category, context): the first steps of a trace as lines, by category."""
    order = Window.orderBy("hop", "category", "entity", "related", "relation", "direction")
    first = steps.orderBy("hop", "category", "entity", "related", "relation", "direction").limit(max_steps).withColumn("n", F.row_number().over(order))
    arrow = F.when(F.col("direction") == "out", F.concat_ws(" ", "entity", F.lit("->"), "relation", F.lit("->"), "related")).otherwise(F.concat_ws(" ", "related", F.lit("->"), "relation", F.lit("->"), "entity"))
    return first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", arrow.alias("t")))), lambda x: x["t"]), "\n").alias("context"))
