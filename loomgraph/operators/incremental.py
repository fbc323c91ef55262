"""Deciding what to redo: fingerprints against checkpoints, upserts, reruns, downstream artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import hashing
from loomgraph.sources import snapshots, tables


def decide(current: DataFrame, checkpoint: DataFrame, key: str = "session_id", mark: str = "turns_hash", version: int | None = None) -> DataFrame:
    """(key, decision): reused where the mark (and the version, if given) is as it was, rechunked where it is not, new without a
    checkpoint, stale where only the checkpoint has the key."""
    old = checkpoint.select(key, F.col(mark).alias("_was"), *([F.col("chunker_version").alias("_v")] if version is not None else []), F.lit(True).alias("_old"))
    same = F.col("_was").eqNullSafe(F.col(mark))
    if version is not None:
        same &= F.col("_v") == version
    joined = current.select(key, mark, F.lit(True).alias("_new")).join(old, key, "full")
    return joined.select(key, F.when(F.col("_new").isNull(), "stale").when(F.col("_old").isNull(), "new").when(same, "reused").otherwise("rechunked").alias("decision"))


def resume_batches(planned: DataFrame, done: DataFrame) -> DataFrame:
    """planned(session, batch_id, content_hash) with `reuse`: the checkpoint has the same batch, hash and status success."""
    good = done.where(F.col("status") == "success").select("session", "batch_id", "content_hash", F.lit(True).alias("_ok")).distinct()
    return planned.join(good, ["session", "batch_id", "content_hash"], "left").withColumn("reuse", F.coalesce("_ok", F.lit(False))).drop("_ok")


def save_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def load_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a checkpoint; none if it is missing, and none of them if any line is not a row of the schema."""
    empty = spark.createDataFrame([], schema)
    if not snapshots.exists(spark, path):
        return empty
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r"))
    if not rows.where("r is null or r._corrupt is not null").isEmpty():
        return empty
    return rows.select("r.*").drop("_corrupt")


def decide_batches(current: DataFrame, checkpoint: DataFrame, batches: DataFrame, key: str = "session") -> DataFrame:
    """(key, done): the fingerprint of current(key, fingerprint) is that of the checkpoint, and no batch of batches(key, status) in it
    is anything but a success."""
    bad = batches.where(F.coalesce(F.col("status") != "success", F.lit(True))).select(key, F.lit(True).alias("_bad")).distinct()
    old = checkpoint.select(key, F.col("fingerprint").alias("_was"))
    joined = current.select(key, "fingerprint").join(old, key, "left").join(bad, key, "left")
    return joined.select(key, (F.coalesce(F.col("_was") == F.col("fingerprint"), F.lit(False)) & F.col("_bad").isNull()).alias("done"))


def carry_over(rows: DataFrame, decided: DataFrame, key: str = "session") -> tuple[DataFrame, DataFrame]:
    """(rows of earlier output that stay: those of sessions that are done, orphans: rows of sessions that are no longer there)."""
    return rows.join(decided.where("done").select(key), key, "left_semi"), rows.join(decided.select(key), key, "left_anti")


def surgery(checkpoint: DataFrame, plan: DataFrame) -> DataFrame:
    """A checkpoint(session, batch_id, status, ...) prepared for rerun_plan()'s rows: sessions to be redone whole are gone, other
    planned batches count as failed. The checkpoint itself stays as it is; snapshots.restore() brings an older one back."""
    whole = plan.where("whole_session").select("session").distinct()
    flip = plan.where("not whole_session").select("session", "batch_id", F.lit(True).alias("_flip")).distinct()
    left = checkpoint.join(whole, "session", "left_anti").join(flip, ["session", "batch_id"], "left")
    return left.withColumn("status", F.when(F.col("_flip"), "failed").otherwise(F.col("status"))).drop("_flip")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new over old, one row for each key; of equal keys within a side, the row of the largest content."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc("_side"), F.desc(F.to_json(F.struct(*[c for c in old.columns if c != key]))))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_side")


def keyed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("point_id", hashing.stable_uuid(F.col(key).cast("string")))


def rerun_plan(batches: DataFrame, bad: Column) -> DataFrame:
    """(session, batch_id, whole_session) from batches(session, batch_id, n_batches, summary): batches with a bad summary; a
    session of one batch is redone whole."""
    return batches.where(bad).select("session", "batch_id", (F.col("n_batches") == 1).alias("whole_session")).distinct()


def downstream(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """(name, hop) reached from changed(name) along deps(phase, needs), against its direction."""
    reached = tables.cut(changed.select("name").distinct().withColumn("hop", F.lit(0)), "reached")
    hop = 0
    while True:
        hop += 1
        new = deps.join(reached.where(F.col("hop") == hop - 1), F.col("needs") == F.col("name")).select(F.col("phase").alias("name")).distinct().join(reached, "name", "left_anti")
        new = tables.cut(new.withColumn("hop", F.lit(hop)), "level")
        if new.isEmpty():
            return reached
        reached = reached.unionByName(new)


def orphans(artifacts: DataFrame, deps: DataFrame, removed: DataFrame) -> DataFrame:
    """artifacts(name, phase) of phases downstream of removed ones that are still there."""
    below = downstream(deps, removed).where("hop > 0").select(F.col("name").alias("phase"))
    return artifacts.join(below, "phase", "left_semi")
