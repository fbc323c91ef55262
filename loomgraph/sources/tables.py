"""Tables by name, and intermediate tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes that a broadcast side may take.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, place: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{place.rstrip('/')}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new temporary one if all of Spark runs in one process (tests);
    on a cluster executors would each write to their own disk, so there it is an error."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(place)
    return place


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark).rstrip('/')}/loomgraph-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: the plan is computed once and stays short, and lost executors
    cost no more than the tasks that they were running."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame | None) -> None:
    """Deletes the files of a table made by cut() that nothing reads any more."""
    if df is None:
        return
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for place in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)


def bytes_of(c: Column, kind: DataType) -> Column:
    """About the bytes that a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return 24 + F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(kind, ArrayType):
        n = F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return 24 + F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + bytes_of(x, kind.elementType)), F.lit(0).cast("long"))
        return 24 + 8 * n
    if isinstance(kind, StructType):
        return reduce(lambda a, f: a + bytes_of(c[f.name], f.dataType), kind.fields, F.lit(16).cast("long"))
    return F.lit(16).cast("long")


def small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if its rows, measured with their texts and arrays, take few enough bytes; beyond that joins shuffle it."""
    size = df.agg(F.sum(reduce(lambda a, f: a + bytes_of(F.col(f"`{f.name}`"), f.dataType), df.schema.fields, F.lit(32).cast("long")))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


#: Rows of a partition that is grouped or sorted in memory.
ROWS_EACH = 250_000


def deal(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about so many rows dealt out by keys into partitions of ROWS_EACH, so that no task's memory grows with the table: partitions
    whose number Spark chooses are few and hold as many rows as compress well."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_EACH)), *keys)


def numbered(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """df with its place in a total order, from 0. The rows are sorted by ranges over all tasks; only the counts of the ranges,
    one row for each, are added up in one place."""
    sorted_ = df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = cut(sorted_, "numbered")
    counts = placed.groupBy("_range").agg(F.count("*").alias("_of"))
    begin = counts.withColumn("_begin", F.coalesce(F.sum("_of").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_begin")
    return placed.join(F.broadcast(begin), "_range").withColumn(name, F.col("_begin") + F.col("_in")).drop("_range", "_in", "_begin")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is read from fewer files than half of them: work on its rows that costs more than moving them
    would else run in one task. Tables of many files stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores // 2 else df
