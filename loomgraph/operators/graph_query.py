"""Queries over the nodes, tasks and edges of a Graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph_build import Graph, degrees
from loomgraph.sources import tables


def get_nodes(nodes: DataFrame, names: list[str]) -> DataFrame:
    return nodes.where(F.col("name").isin(list(names)))


def get_edges(edges: DataFrame, name: str, direction: str = "both") -> DataFrame:
    """Edges of a node with a column direction (out or in); a self-loop comes twice under both."""
    out = edges.where(F.col("head") == name).withColumn("direction", F.lit("out"))
    into = edges.where(F.col("tail") == name).withColumn("direction", F.lit("in"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def tasks_of(graph: Graph, name: str) -> DataFrame:
    return graph.tasks.where(F.col("name") == name).select("task")


def _like(query: str) -> str:
    return query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search_ranked(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(name, rank): names and aliases that contain the query, whatever its case. Rank 0: the name is equal; 1: it begins so;
    2, 3: an alias does; 4: the name contains it; 5: an alias does. Then shorter names, more tasks, spelling."""
    query = query.strip()
    if not query:
        return nodes.select("name", F.lit(0).alias("rank"), "task_count").limit(0)
    part, begin = f"%{_like(query)}%", f"{_like(query)}%"
    rows = nodes.select("name", "task_count", F.explode_outer("aliases").alias("alias"))
    rank = (
        F.when(F.col("name") == query, 0)
        .when(F.col("name").ilike(begin), 1)
        .when(F.col("alias") == query, 2)
        .when(F.col("alias").ilike(begin), 3)
        .when(F.col("name").ilike(part), 4)
        .otherwise(5)
    )
    hit = rows.where(F.col("name").ilike(part) | F.col("alias").ilike(part))
    best = hit.groupBy("name", "task_count").agg(F.min(rank).alias("rank"))
    return best.orderBy("rank", F.length("name"), F.desc("task_count"), "name").limit(max(1, min(200, limit))).select("name", "rank", "task_count")


def search_exact(nodes: DataFrame, query: str, limit: int = 20, mode: str = "exact") -> DataFrame:
    """(name, task_count): a name or alias is equal to the query, whatever its case, or (mode word) has it as a whole word."""
    low = query.strip().lower()
    if mode == "exact":
        fits = lambda c: F.lower(c) == low
    else:
        quoted = "\\Q" + low.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        fits = lambda c: F.rlike(F.lower(c), F.lit(f"(?U)\\b{quoted}\\b"))
    hit = nodes.where(fits(F.col("name")) | F.exists("aliases", fits)) if low else nodes.limit(0)
    return hit.orderBy(F.desc("task_count"), "name").limit(max(1, min(200, limit))).select("name", "task_count")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 2, max_nodes: int | None = None) -> DataFrame:
    """(name, hop): names reached from seeds(name) along edges in either direction, seeds included, even unknown ones.

    Level by level; a level that would exceed max_nodes keeps the first names by spelling. Each level is one join of
    the new names with the edges, one anti-join with those already reached, and is written down.
    """
    near = edges.select(F.col("head").alias("at"), F.col("tail").alias("to")).union(edges.select("tail", "head"))
    reached = tables.cut(seeds.select("name").distinct().withColumn("hop", F.lit(0)), "reached")
    for hop in range(1, depth + 1):
        n = reached.count()
        if max_nodes is not None and n >= max_nodes:
            break
        new = near.join(reached.where(F.col("hop") == hop - 1), F.col("at") == F.col("name")).select(F.col("to").alias("name")).distinct().join(reached, "name", "left_anti")
        if max_nodes is not None:
            new = new.orderBy("name").limit(max_nodes - n)
        new = tables.cut(new.withColumn("hop", F.lit(hop)), "level")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
    return reached


def bfs_each(edges: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int | None = None) -> DataFrame:
    """(query, name, hop): bfs() for the seeds(query, name) of many queries at once, with the cap for each query."""
    near = edges.select(F.col("head").alias("at"), F.col("tail").alias("to")).union(edges.select("tail", "head"))
    reached = tables.cut(seeds.select("query", "name").distinct().withColumn("hop", F.lit(0)), "reached")
    for hop in range(1, depth + 1):
        new = near.join(reached.where(F.col("hop") == hop - 1), F.col("at") == F.col("name")).select("query", F.col("to").alias("name")).distinct().join(reached, ["query", "name"], "left_anti")
        if max_nodes is not None:
            have = reached.groupBy("query").agg(F.count("*").alias("have"))
            place = F.row_number().over(Window.partitionBy("query").orderBy("name"))
            new = new.withColumn("n", place).where(F.col("n") <= max_nodes).join(have, "query").where(F.col("n") + F.col("have") <= max_nodes).select("query", "name")
        new = tables.cut(new.withColumn("hop", F.lit(hop)), "level")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
    return reached


def query_kg(graph: Graph, tasks: DataFrame, entity: str, depth: int = 2, max_nodes: int = 30) -> DataFrame:
    """Tasks of all entities around the best match for a name: exact first, else the first fuzzy hit."""
    exact = graph.nodes.where(F.col("name") == entity).select("name", F.lit(-1).alias("rank"))
    seed = exact.unionByName(search_ranked(graph.nodes, entity, 1).select("name", "rank")).orderBy("rank").limit(1).select("name")
    around = bfs(graph.edges, seed, depth, max_nodes)
    found = graph.tasks.join(tables.small(around), "name", "left_semi").select("task").distinct()
    return tasks.join(found, "task", "left_semi")


def top_entities(nodes: DataFrame, limit: int = 10) -> DataFrame:
    return nodes.orderBy(F.desc("task_count"), "name").limit(limit)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, avg_task_count, n_edges, n_modes."""
    return nodes.agg(F.count("*").alias("n_nodes"), F.round(F.avg("task_count"), 2).alias("avg_task_count")).crossJoin(edges.agg(F.count("*").alias("n_edges"), F.count_distinct("extraction_mode").alias("n_modes")))


def prune(nodes: DataFrame, edges: DataFrame, max_nodes: int = 500) -> tuple[DataFrame, DataFrame]:
    """The max_nodes names of the highest degree and the edges among them; all if there are no more."""
    degree = nodes.select("name").join(degrees(edges), "name", "left").select("name", F.coalesce("degree", F.lit(0)).alias("degree"))
    kept = degree.orderBy(F.desc("degree"), "name").limit(max_nodes).select("name")
    ends = edges.join(kept.select(F.col("name").alias("head")), "head", "left_semi").join(kept.select(F.col("name").alias("tail")), "tail", "left_semi")
    return nodes.join(kept, "name", "left_semi"), ends


def without_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("head", "tail")).alias("name")).distinct(), "name", "left_semi")


def visual_scale(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node sizes 10 to 50 by degree and labels of 21 characters at most; edge widths 1 + 3 x weight."""
    degree = nodes.join(degrees(edges), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    most = degree.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    label = F.when(F.length("name") > 20, F.concat(F.substring("name", 1, 18), F.lit("..."))).otherwise(F.col("name"))
    return degree.crossJoin(F.broadcast(most)).withColumn("size", 10 + 40 * F.col("degree") / F.col("most")).withColumn("label", label).drop("most"), edges.withColumn("width", 1 + 3 * F.col("weight"))


def type_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("entity_type").agg(F.count("*").alias("n"))


def trace(edges: DataFrame, categories: DataFrame, root: str, hops: int = 3, cap: int = 50) -> DataFrame:
    """Decision steps (entity, related, relation, category, hop, direction, source_task, weight) around a root.

    Every edge of a reached name whose relation has a category is a step, at one hop more than the name; of equal
    (entity, related, relation, direction) the heaviest stays, of equally heavy ones the nearest.
    """
    # The cap keeps the first names by (hop, spelling), as bfs() fills it.
    reached = bfs(edges, edges.sparkSession.createDataFrame([(root,)], "name string"), hops - 1, cap or None)
    known = edges.join(tables.small(categories), "relation")
    side = lambda at, to, how: known.select(F.col(at).alias("entity"), F.col(to).alias("related"), "relation", "category", F.lit(how).alias("direction"), "source_task", "weight")
    steps = side("head", "tail", "out").unionByName(side("tail", "head", "in")).join(tables.small(reached), F.col("entity") == F.col("name")).withColumn("hop", F.col("hop") + 1)
    best = Window.partitionBy("entity", "related", "relation", "direction").orderBy(F.desc("weight"), "hop", "source_task")
    return steps.withColumn("n", F.row_number().over(best)).where("n = 1").select("entity", "related", "relation", "category", "hop", "direction", "source_task", "weight")


#: Relations that tell a decision, by category.
DECISIONS = {
    "选用": ["使用", "集成了", "实现", "实现了", "支持", "通过兼容层加载", "保留fallback模型", "保留"],
    "选型": ["对比", "对比了", "区别于", "适用于", "适合", "支持精度"],
    "排除": ["禁用", "缺少", "阻塞于", "阉割了"],
    "替换": ["替代了", "新增了", "补充了"],
    "依赖": ["属于", "包含", "对应"],
}


def related_tasks(steps: DataFrame, graph: Graph) -> DataFrame:
    """(task): tasks of the steps and of the nodes they name, once each."""
    named = steps.select(F.explode(F.array("entity", "related")).alias("name")).distinct()
    of_nodes = graph.tasks.join(named, "name", "left_semi").select("task")
    return steps.select(F.col("source_task").alias("task")).unionByName(of_nodes).where("task is not null").distinct()


def anti_idf(graph: Graph, names: DataFrame, tasks: DataFrame, limit: int = 50) -> DataFrame:
    """(task, score): the sum over reached entities of ln(1 + N / their number of tasks), rare entities weighing more; N is the
    number of tasks. Tasks that the catalogue lacks do not count."""
    n = tasks.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    hit = graph.nodes.join(names.select("name"), "name", "left_semi").crossJoin(F.broadcast(n))
    part = F.log1p(F.col("n") / F.greatest(F.col("task_count"), F.lit(1)))
    scored = graph.tasks.join(tables.small(hit.select("name", part.alias("part"))), "name").groupBy("task").agg(F.sum("part").alias("score"))
    return scored.join(tasks.select("task"), "task", "left_semi").orderBy(F.round("score", 9).desc(), "task").limit(limit)


def anti_idf_each(graph: Graph, names: DataFrame, tasks: DataFrame, limit: int = 50) -> DataFrame:
    """(query, doc, score, rank): anti_idf() for the names(query, name) of many queries."""
    n = tasks.count()
    weight = graph.nodes.join(names.select("name").distinct(), "name", "left_semi").select("name", F.log1p(F.lit(max(n, 1)) / F.greatest(F.col("task_count"), F.lit(1))).alias("part"))
    asked = names.select("query", "name").distinct().join(weight, "name")
    scored = graph.tasks.join(tables.small(asked), "name").groupBy("query", F.col("task").alias("doc")).agg(F.sum("part").alias("score"))
    known = scored.join(tasks.select(F.col("task").alias("doc")), "doc", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "doc"))
    return known.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "doc", "score", "rank")
