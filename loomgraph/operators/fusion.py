"""Reciprocal rank fusion and the roll-up of chunk hits to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources import tables


def rrf(first: DataFrame, second: DataFrame, k: int = 60, doc: str = "doc", query: str = "query") -> DataFrame:
    """(query, doc, score, first_rank, second_rank, rank) of two ranked lists: the sum of 1 / (k + rank). Ties: by the rank in
    the first list, then in the second, then by id."""
    a = first.select(query, doc, F.col("rank").alias("first_rank"))
    b = second.select(query, doc, F.col("rank").alias("second_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return ranked(a.join(b, [query, doc], "full").withColumn("score", part("first_rank") + part("second_rank")), doc, query)


def weighted_rrf(vector: DataFrame, graph: DataFrame, k: int = 30, graph_weight: float = 0.3, doc: str = "doc", query: str = "query") -> DataFrame:
    """(1 - g) / (k + vector rank) + g / (k + graph rank), with a missing rank as 0."""
    if not 0 <= graph_weight <= 1:
        raise ValueError("graph_weight lies from 0 to 1")
    a = vector.select(query, doc, F.col("rank").alias("first_rank"))
    b = graph.select(query, doc, F.col("rank").alias("second_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return ranked(a.join(b, [query, doc], "full").withColumn("score", part("first_rank", 1 - graph_weight) + part("second_rank", graph_weight)), doc, query)


def ranked(scored: DataFrame, doc: str = "doc", query: str = "query") -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.round("score", 12).desc(), F.col("first_rank").asc_nulls_last(), F.col("second_rank").asc_nulls_last(), F.col(doc))
    return scored.withColumn("rank", F.row_number().over(order))


def chunks_to_tasks(hits: DataFrame, chunk_tasks: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """(query, doc = task, score, rank): the best chunk's score for each task; chunks without a known task go."""
    known = chunk_tasks.where(F.col("task").isNotNull())
    if tasks is not None:
        known = known.join(tasks.select("task"), "task", "left_semi")
    hits = tables.cut(hits, "hits")
    best = known.join(tables.small(hits), hits.doc == known.chunk).groupBy("query", "task").agg(F.max("score").alias("score"), F.min("rank").alias("best_rank"))
    order = Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "best_rank", "task")
    return best.select("query", F.col("task").alias("doc"), "score", F.row_number().over(order).alias("rank"))


def chunk_to_task(tasks: DataFrame) -> DataFrame:
    """(chunk, task) from tasks(task, pos, chunk_ids): of several owners the last one holds."""
    return tasks.select("task", "pos", F.explode("chunk_ids").alias("chunk")).groupBy("chunk").agg(F.max_by("task", "pos").alias("task"))


def source_distribution(fused: DataFrame) -> DataFrame:
    """(source, n): rows found by both lists, by the second (graph) or by the first (vector) alone."""
    kind = F.when(F.col("first_rank").isNotNull() & F.col("second_rank").isNotNull(), "both").when(F.col("second_rank").isNotNull(), "graph").otherwise("vector")
    return fused.groupBy(kind.alias("source")).agg(F.count("*").alias("n"))


def configuration_diff(old: DataFrame, new: DataFrame, query: str = "query") -> DataFrame:
    """Position by position: what two ranked lists have at each rank, and whether each side's row is new or lost in the other."""
    a = old.select(query, "rank", F.col("doc").alias("old_doc"))
    b = new.select(query, "rank", F.col("doc").alias("new_doc"))
    side = a.join(b, [query, "rank"], "full")
    olds, news = old.select(query, F.col("doc").alias("new_doc"), F.lit(True).alias("in_old")), new.select(query, F.col("doc").alias("old_doc"), F.lit(True).alias("in_new"))
    joined = side.join(olds, [query, "new_doc"], "left").join(news, [query, "old_doc"], "left")
    return joined.select(query, "rank", "old_doc", "new_doc", F.coalesce(F.col("old_doc") == F.col("new_doc"), F.lit(False)).alias("same"), (F.col("new_doc").isNotNull() & F.col("in_old").isNull()).alias("is_new"), (F.col("old_doc").isNotNull() & F.col("in_new").isNull()).alias("is_lost"))


def score_shifts(old: DataFrame, new: DataFrame, most: int = 10, query: str = "query") -> DataFrame:
    """(query, doc, old_score, new_score, shift): of rows that both lists have, the largest rises of the score."""
    both = old.select(query, "doc", F.col("score").alias("old_score")).join(new.select(query, "doc", F.col("score").alias("new_score")), [query, "doc"])
    risen = both.withColumn("shift", F.col("new_score") - F.col("old_score")).where(F.round("shift", 9) > 0)
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.round("shift", 9).desc(), "doc"))
    return risen.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
