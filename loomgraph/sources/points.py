"""Points: rows with a stable id, a vector and sparse weights, as a vector store keeps them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import hashing, text
from loomgraph.sources import tables


def scan(points: DataFrame, with_vectors: bool = False, vectors: tuple[str, ...] = ("embedding", "sparse")) -> DataFrame:
    """All points; their vectors are not even read unless they are asked for."""
    return points if with_vectors else points.drop(*vectors)


def lookup(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    """The points of the distinct ids(key); unknown ids give nothing."""
    return points.join(tables.small(ids.select(key).distinct()), key, "left_semi")


def chunk_points(chunks: DataFrame, owners: DataFrame, embed: Callable[[Column], Column], body: str = "summary") -> DataFrame:
    """(chunk, point_id, task, body, embedding, sparse): a point for each chunk(chunk, body) whose body is not empty; task is that of
    owners(chunk, task), '' without one; sparse is a map of the body's tokens to their counts."""
    rows = chunks.where(F.coalesce(F.col(body), F.lit("")) != "").select("chunk", F.col(body).alias("body"))
    words = rows.select("chunk", F.explode(text.tokens("body")).alias("t")).groupBy("chunk", "t").agg(F.count("*").cast("int").alias("n"))
    sparse = words.groupBy("chunk").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("sparse"))
    joined = rows.join(owners.groupBy("chunk").agg(F.max("task").alias("task")), "chunk", "left").join(sparse, "chunk", "left")
    return joined.select("chunk", hashing.stable_uuid(F.col("chunk").cast("string")).alias("point_id"), F.coalesce(F.col("task").cast("string"), F.lit("")).alias("task"), "body", embed(F.col("body")).alias("embedding"), "sparse")
