"""A stream of turns kept chunked: each micro-batch adds its turns to the log and chunks the touched sessions again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators import sessions
from loomgraph.sources import tables

TURNS = "session_id string, turn_no int, role string, content string"
#: Folders that a batch's log is dealt into by session; a batch reads those of its own sessions back, no others.
BUCKETS = 64


def rechunk_stream(turns: DataFrame, log: str, chunks: str, checkpoint: str, min_user: int = 1) -> StreamingQuery:
    """Turns go to `log` (Parquet, in buckets of sessions); every micro-batch writes the chunks of the sessions it touched to
    chunks/batch=<id>. A batch that runs again after a failure writes the same folders. A turn that comes again replaces the one
    before it; within a batch the last by content holds. latest_chunks() reads the newest state of each session."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/batch={batch_id}")
        touched = spark.read.parquet(f"{log}/batch={batch_id}").select("session_id", "bucket").distinct()
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # BUCKETS at most
        known = spark.read.option("basePath", log).parquet(f"{log}/batch=*").where((F.col("batch") <= batch_id) & F.col("bucket").isin(buckets))
        mine = known.join(tables.small(touched.select("session_id")), "session_id", "left_semi")
        newest = Window.partitionBy("session_id", "turn_no").orderBy(F.desc("batch"), F.desc(F.to_json(F.struct(*batch.columns))))
        whole = mine.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "batch", "bucket")
        sessions.chunk_sessions(whole, min_user).write.mode("overwrite").parquet(f"{chunks}/batch={batch_id}")

    return turns.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chunks(spark, chunks: str) -> DataFrame:
    rows = spark.read.option("basePath", chunks).parquet(f"{chunks}/batch=*")
    newest = rows.groupBy("session_id").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return rows.join(newest, ["session_id", "batch"]).drop("batch")
