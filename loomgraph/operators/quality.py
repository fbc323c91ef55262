"""Inspection: histograms, coverage, near neighbours, retrieval hits, duplicate keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import vectors
from loomgraph.sources import tables


def count_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """(n_items, n_keys): how many keys have how many rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n_items")).groupBy("n_items").agg(F.count("*").alias("n_keys"))


def size_stats(rows: DataFrame, array: str) -> DataFrame:
    n = F.size(array)
    return rows.agg(F.avg(n).alias("avg_size"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.sum(n).alias("total"))


def length_stats(rows: DataFrame, column: str, short: int) -> DataFrame:
    n = F.length(column)
    return rows.agg(F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.count_if(n < short).alias("n_short"))


def token_totals(chunks: DataFrame) -> DataFrame:
    """raw_tokens, cleaned_tokens, their ratio, the share of chunks with a summary and the number without a task."""
    has = F.coalesce(F.col("summary") != "", F.lit(False))
    return chunks.agg(
        F.sum("raw_size_tokens").alias("raw_tokens"),
        F.sum("cleaned_size_tokens").alias("cleaned_tokens"),
        (F.sum("cleaned_size_tokens") / F.nullif(F.sum("raw_size_tokens"), F.lit(0))).alias("ratio"),
        F.avg(has.cast("int")).alias("coverage"),
        F.count_if(F.col("task").isNull()).alias("without_task"),
    )


def neighbours(points: DataFrame, first: int = 10, k: int = 4, near: float = 0.85, name: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """(a, b, score, rank, is_near): for the first points by name their best others among the top k, themselves included."""
    unit = points.select(F.col(name).alias("name"), vectors.normalize(F.col(vector)).alias("v"))
    few = unit.orderBy("name").limit(first).select(F.col("name").alias("a"), F.col("v").alias("va"))
    scored = unit.crossJoin(F.broadcast(few)).select("a", F.col("name").alias("b"), vectors.dot(F.col("va"), F.col("v")).alias("score"))
    order = Window.partitionBy("a").orderBy(F.round("score", 9).desc(), "b")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("a") != F.col("b"))).withColumn("is_near", F.col("score") > near)


def retrieval_hits(ranked: DataFrame, tasks: DataFrame, keywords: DataFrame, k: int = 5) -> DataFrame:
    """(query, nominal, effective, drift) from ranked(query, doc, rank), tasks(doc, label, summary) and keywords(query, word).

    nominal: a word is in the label or summary of a task among the first k; effective: the first task with a word in its
    label is among them; drift: nominal and not effective.
    """
    rows = tasks.join(tables.small(tables.cut(ranked, "ranked")), "doc").join(tables.small(keywords), "query")
    label = F.contains(F.lower("label"), F.lower("word"))
    either = label | F.contains(F.lower("summary"), F.lower("word"))
    out = rows.groupBy("query").agg(F.coalesce(F.bool_or(either & (F.col("rank") <= k)), F.lit(False)).alias("nominal"), F.coalesce(F.min(F.when(label, F.col("rank"))) <= k, F.lit(False)).alias("effective"))
    return out.withColumn("drift", F.col("nominal") & ~F.col("effective"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed."""
    a, b = old.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")), new.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def model_rollup(runs: DataFrame) -> DataFrame:
    """(model, n_runs, success_rate, avg_latency, p50, p90) from runs(model, ok, latency). Percentiles are exact: all latencies are
    numbered in one total order, by ranges, and each model's two rows around a percentile are picked by number."""
    plain = runs.groupBy("model").agg(F.count("*").alias("n_runs"), F.avg(F.col("ok").cast("int")).alias("success_rate"), F.avg("latency").alias("avg_latency"), F.count("latency").alias("_m"))
    plain = tables.cut(plain, "models")
    placed = tables.numbered(runs.where("latency is not null").select("model", F.col("latency").cast("double").alias("latency")), "model", "latency")
    begin = placed.groupBy("model").agg(F.min("n").alias("_begin"))
    spots = plain.where("_m > 0").join(begin, "model").select("model", F.explode(F.array(F.lit(0.5), F.lit(0.9))).alias("p"), "_m", "_begin").withColumn("at", F.col("p") * (F.col("_m") - 1))
    ends = spots.select("model", "p", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("k"), "_begin").withColumn("n", F.col("_begin") + F.col("k"))
    near = placed.select("n", "latency").join(tables.small(ends), "n").groupBy("model", "p", "at").agg(F.min_by("latency", "k").alias("low"), F.max_by("latency", "k").alias("high"))
    value = near.select("model", "p", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("v"))
    both = value.groupBy("model").agg(F.max(F.when(F.col("p") == 0.5, F.col("v"))).alias("p50"), F.max(F.when(F.col("p") == 0.9, F.col("v"))).alias("p90"))
    return plain.drop("_m").join(both, "model", "left")


def every_nth(keys: DataFrame, key: str, size: str, take: int) -> DataFrame:
    """`take` keys spread evenly over the order by size: every n/take-th."""
    total = keys.agg(F.greatest(F.floor(F.count("*") / take), F.lit(1)).alias("step"))
    return tables.numbered(keys, size, key).crossJoin(F.broadcast(total)).where((F.col("n") % F.col("step") == 0) & (F.col("n") / F.col("step") < take)).drop("n", "step")


def verify_rerun(old: DataFrame, new: DataFrame, key: str, chunk: str, bad: Column) -> DataFrame:
    """One row: keys that repeat in new, chunks that only one side has, rows of new that are still bad."""
    lost = old.select(chunk).distinct().exceptAll(new.select(chunk).distinct()).agg(F.count("*").alias("n_lost"))
    added = new.select(chunk).distinct().exceptAll(old.select(chunk).distinct()).agg(F.count("*").alias("n_added"))
    repeated = duplicate_keys(new, key).agg(F.count("*").alias("n_repeated"))
    return repeated.crossJoin(lost).crossJoin(added).crossJoin(new.agg(F.count_if(bad).alias("n_bad")))


def sample_rows(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n rows drawn evenly."""
    return rows.orderBy(F.rand(seed)).limit(n)


def collection_stats(**collections: DataFrame) -> DataFrame:
    """(name, n_rows, dim): dim is the length of the embeddings, null without any."""
    one = lambda name, df: df.agg(F.count("*").alias("n_rows"), (F.max(F.size("embedding")) if "embedding" in df.columns else F.lit(None)).cast("int").alias("dim")).select(F.lit(name).alias("name"), "n_rows", "dim")
    return reduce(DataFrame.unionByName, [one(k, v) for k, v in sorted(collections.items())])


def conclusions(hits: DataFrame, pairs: DataFrame, summaries: DataFrame, chunks: DataFrame, short: int = 50) -> DataFrame:
    """(fact, n) of the facts that hold: drift, queries without a hit, near pairs, short summaries, chunks without a task."""
    facts = {
        "drift": hits.where("drift"),
        "no hit": hits.where("not nominal"),
        "near pairs": pairs.where("is_near"),
        "short summaries": summaries.where(F.length("summary") < short),
        "chunks without a task": chunks.where("task is null"),
    }
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fact"), "n") for name, df in facts.items()]
    return reduce(DataFrame.unionByName, counted).where("n > 0")
