"""Snapshots of written tables: copies under a name, listed, restored, and dropped by age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def snapshot(table: DataFrame, root: str, name: str) -> str:
    """Copies a table to root/name; an older one of that name is replaced."""
    path = f"{root.rstrip('/')}/{name}"
    table.write.mode("overwrite").parquet(path)
    return path


def names(spark: SparkSession, root: str) -> list[str]:
    """The names of finished snapshots, in order."""
    fs, at = _fs(spark, root)
    if not fs.exists(at):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory() and exists(spark, f"{root.rstrip('/')}/{f.getPath().getName()}/_SUCCESS"))


def restore(spark: SparkSession, root: str, name: str) -> DataFrame:
    if name not in names(spark, root):
        raise FileNotFoundError(f"no snapshot {name}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def keep_newest(spark: SparkSession, root: str, n: int) -> list[str]:
    """Drops all but the last n snapshots by name; gives the dropped names."""
    found = names(spark, root)
    gone = found[: max(0, len(found) - n)]
    for name in gone:
        fs, at = _fs(spark, f"{root.rstrip('/')}/{name}")
        fs.delete(at, True)
    return gone


def drop_table(spark: SparkSession, path: str, backups: str, name: str) -> str:
    """Deletes a written table after a snapshot of it; gives the snapshot's path."""
    kept = snapshot(spark.read.parquet(path), backups, name)
    fs, at = _fs(spark, path)
    fs.delete(at, True)
    return kept


def inventory(spark: SparkSession, root: str, phases: dict[str, list[str]]) -> DataFrame:
    """(phase, name, present, bytes): the artifacts of each phase under root, in the phases' order. A name that leaves root is an
    error."""
    rows = []
    for order, (phase, artifacts) in enumerate(phases.items()):
        for name in artifacts:
            if name.startswith("/") or ".." in name.split("/") or "://" in name:
                raise ValueError(f"{name} is not under {root}")
            fs, at = _fs(spark, f"{root.rstrip('/')}/{name}")
            present = fs.exists(at)
            rows.append((order, phase, name, present, fs.getContentSummary(at).getLength() if present else 0))
    return spark.createDataFrame(rows, "n int, phase string, name string, present boolean, bytes long").orderBy("n", "name").drop("n")
