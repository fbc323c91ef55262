"""Graph files and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.graph_build import Graph

NODE_LINK = "nodes array<struct<id:string,entity_type:string,aliases:array<string>,source_tasks:array<string>>>, links array<struct<source:string,target:string,relation:string,weight:double,source_task:string>>"


def read_node_link(spark: SparkSession, path: str) -> Graph:
    """The graph of a node-link JSON document."""
    doc = spark.read.schema(NODE_LINK).option("multiLine", True).json(path)
    rows = doc.select(F.explode("nodes").alias("n")).where("n.id is not null")
    nodes = rows.select(F.col("n.id").alias("name"), "n.entity_type", "n.aliases", F.size("n.source_tasks").alias("task_count"))
    tasks = rows.select(F.col("n.id").alias("name"), F.explode("n.source_tasks").alias("task")).distinct()
    edges = doc.select(F.explode("links").alias("l")).where("l.source is not null").select(F.col("l.source").alias("head"), "l.relation", F.col("l.target").alias("tail"), "l.weight", "l.source_task")
    return Graph(nodes, tasks, edges)


def write_graph(graph: Graph, path: str, mode: str) -> None:
    """Nodes and their tasks whole, edges by extraction mode: writing one mode again replaces its edges and leaves the others."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.tasks.write.mode("overwrite").parquet(f"{path}/tasks")
    graph.edges.drop("extraction_mode").write.mode("overwrite").parquet(f"{path}/edges/extraction_mode={mode}")


def write_rows(rows: DataFrame, path: str, order: str | None = None) -> None:
    """JSON lines; the committer makes the job's output appear at once. A given order is a range partitioning, not one task."""
    (rows.orderBy(order) if order else rows).write.mode("overwrite").json(path)


def write_entities(graph: Graph, names: DataFrame, canonical: DataFrame, path: str) -> None:
    """entities.json: every name with its type and canonical name, by name. inverted_index.json: canonical names with their aliases,
    the most tasks first. entity_tasks.json: their tasks, one a row."""
    named = names.join(canonical, "name", "left").withColumn("canonical_name", F.coalesce("canonical", "name")).drop("canonical")
    write_rows(named, f"{path}/entities.json", "name")
    graph.nodes.orderBy(F.desc("task_count"), "name").write.mode("overwrite").json(f"{path}/inverted_index.json")
    write_rows(graph.tasks, f"{path}/entity_tasks.json")


def write_node_link(graph: Graph, path: str) -> None:
    """The graph as one node-link JSON document, in one file: its lines are sorted into place and written one after another."""
    tasks = graph.tasks.groupBy("name").agg(F.array_sort(F.collect_set(F.col("task").cast("string"))).alias("source_tasks"))
    nodes = graph.nodes.join(tasks, "name", "left").select(F.to_json(F.struct(F.col("name").alias("id"), "entity_type", "aliases", F.coalesce("source_tasks", F.array().cast("array<string>")).alias("source_tasks"))).alias("row"))
    links = graph.edges.select(F.to_json(F.struct(F.col("head").alias("source"), F.col("tail").alias("target"), "relation", F.col("weight").cast("double").alias("weight"), F.col("source_task").cast("string").alias("source_task"))).alias("row"))
    spark = nodes.sparkSession
    # Each list begins with an empty object that readers skip, so that every other line may begin with a comma.
    fixed = spark.createDataFrame([(0, '{"nodes":[{}'), (2, '],"links":[{}'), (4, "]}")], "part int, row string")
    comma = F.concat(F.lit(","), F.col("row")).alias("row")
    lines = fixed.unionByName(nodes.select(F.lit(1).alias("part"), comma)).unionByName(links.select(F.lit(3).alias("part"), comma))
    lines.repartition(1).sortWithinPartitions("part", "row").select("row").write.mode("overwrite").text(path)


def write_html(nodes: DataFrame, edges: DataFrame, path: str, title: str = "Graph") -> None:
    """A page that draws a pruned graph: nodes(name, entity_type, size, label) and edges(head, relation, tail, width) of
    graph_query.prune() and visual_scale(), which bound both. Written by the driver."""
    import html as escape
    import math

    points, lines = nodes.orderBy("name").collect(), edges.orderBy("head", "tail", "relation").collect()
    at = {r["name"]: (500 + 440 * math.cos(2 * math.pi * i / max(len(points), 1)), 500 + 440 * math.sin(2 * math.pi * i / max(len(points), 1))) for i, r in enumerate(points)}
    out = [f"<!DOCTYPE html><meta charset=utf-8><title>{escape.escape(title)}</title><svg viewBox='0 0 1000 1000'>"]
    for e in lines:
        if e["head"] in at and e["tail"] in at:
            (x1, y1), (x2, y2) = at[e["head"]], at[e["tail"]]
            out.append(f"<line x1='{x1:.1f}' y1='{y1:.1f}' x2='{x2:.1f}' y2='{y2:.1f}' stroke='#999' stroke-width='{e['width']:.2f}'><title>{escape.escape(str(e['relation']))}</title></line>")
    for r in points:
        x, y = at[r["name"]]
        out.append(f"<circle cx='{x:.1f}' cy='{y:.1f}' r='{r['size'] / 4:.1f}'><title>{escape.escape(str(r['name']))} ({escape.escape(str(r['entity_type']))})</title></circle><text x='{x:.1f}' y='{y:.1f}'>{escape.escape(str(r['label']))}</text>")
    rows = nodes.sparkSession.createDataFrame([("".join(out) + "</svg>",)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)
