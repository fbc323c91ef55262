import json

import pytest
from loomgraph.operators import graph_build, graph_query, incremental
from loomgraph.sources import graphs, html_tables
from pyspark.sql import functions as F


def edges(spark, *es):
    return spark.createDataFrame([(a, r, b, float(w), t) for a, r, b, w, t in es], "head string, relation string, tail string, weight double, source_task string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def test_components_take_the_shortest_name(spark):
    pairs = spark.createDataFrame([("abc", "ab"), ("ab", "abcd"), ("zz", "aa"), ("x", "x")], "a string, b string")
    got = {r.name: r.canonical for r in graph_build.components(pairs, seeds(spark, "abc", "ab", "abcd", "zz", "aa", "alone")).collect()}
    assert got == {"abc": "ab", "ab": "ab", "abcd": "ab", "zz": "aa", "aa": "aa", "alone": "alone"}


def test_partitions_grow_in_number_not_in_rows(spark, monkeypatch):
    """Mentions, pairs and tasks are grouped in partitions whose rows have a bound; Spark would choose a fixed number of partitions."""
    from loomgraph.sources import tables

    monkeypatch.setattr(tables, "ROWS_EACH", 100)
    t = spark.range(1000).select(F.concat(F.lit("a"), F.col("id") % 50).alias("head"), F.lit("r").alias("relation"), F.concat(F.lit("b"), "id").alias("tail"), F.lit(1.0).alias("confidence"), (F.col("id") / 4).cast("long").alias("source_task"))
    named = tables.cut(graph_build.mentions(t), "mentions")
    assert named.count() == 2000 and len(named.inputFiles()) >= 15
    same = named.select("name", F.col("name").alias("canonical")).distinct()
    g = graph_build.graph_of(named, same, t, keep=True)
    assert len(g.tasks.inputFiles()) >= 15 and sorted(map(tuple, g.tasks.collect())) == sorted(map(tuple, named.collect()))
    assert {r.name: r.task_count for r in g.nodes.collect()}["a7"] == 20
    seen = t.select(F.col("source_task").alias("task"), F.col("tail").alias("entity"), F.col("source_task").alias("pos"))
    pairs = tables.cut(graph_build.cooccurrence(seen), "pairs")
    assert pairs.count() == 1500 and len(pairs.inputFiles()) >= 15


def test_components_of_a_long_chain(spark):
    n = 60
    pairs = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(n)], "a string, b string")
    names = seeds(spark, *[f"n{i:03}" for i in range(n + 1)])
    assert {r.canonical for r in graph_build.components(pairs, names).collect()} == {"n000"}


def test_similar_pairs_agree_with_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 16))
    x[30:] = x[:30] + 0.08 * rng.standard_normal((30, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "name int, embedding array<double>")
    rows = lambda **k: {(r.a, r.b) for r in graph_build.similar_pairs(df, **k).collect()}
    assert rows() == rows(planes=0) and len(rows()) >= 30


@pytest.mark.parametrize("block, cells, kind", [(32_768, 4_000_000, "int"), (7, 20, "string")])
def test_similar_pairs_by_blocks(spark, monkeypatch, block, cells, kind):
    """All pairs, whatever the blocks: copies, repeated names, other lengths, nulls; none is shuffled as a candidate."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, (3 * x[i % 4]).tolist()) for i in range(20)]
    rows += [(3, x[5].tolist()), (200, None), (201, [0.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [1.0, 2.0]), (204, [2.0, 4.0])]
    monkeypatch.setattr(graph_build, "POINT_BLOCK", block)
    monkeypatch.setattr(graph_build, "_CELLS", cells)
    name = str if kind == "string" else int
    whole = [(name(i), np.array(v)) for i, v in rows if v and None not in v and any(v)]
    cos = lambda u, v: u @ v / np.sqrt((u @ u) * (v @ v))
    want = {(a, b) for a, u in whole for b, v in whole if a < b and len(u) == len(v) and cos(u, v) >= 0.8}
    df = spark.createDataFrame(rows, "name int, embedding array<double>").select(F.col("name").cast(kind).alias("name"), "embedding")
    got = [(r.a, r.b) for r in graph_build.similar_pairs(df, 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_triple_graph(spark):
    t = spark.createDataFrame([("A", "r", "B", 0.5, "T1"), ("A", "r", "B", 0.7, "T2"), ("Bb", "r", "Bb", 1.0, "T3")], "head string, relation string, tail string, confidence double, source_task string")
    canonical = spark.createDataFrame([("A", "A"), ("B", "B"), ("Bb", "B")], "name string, canonical string")
    g = graph_build.triple_graph(t, canonical)
    nodes, es = g.nodes, g.edges
    assert {r.name: (r.aliases, r.task_count) for r in nodes.collect()} == {"A": ([], 2), "B": (["Bb"], 3)}
    assert sorted(map(tuple, g.tasks.collect())) == [("A", "T1"), ("A", "T2"), ("B", "T1"), ("B", "T2"), ("B", "T3")]
    assert [r.task for r in graph_query.tasks_of(g, "A").orderBy("task").collect()] == ["T1", "T2"]
    assert sorted((r.head, r.tail, r.weight) for r in es.collect()) == [("A", "B", 0.5), ("A", "B", 0.7), ("B", "B", 1.0)]
    assert {r.name: r.degree for r in graph_build.degrees(es).collect()} == {"A": 2, "B": 4}
    s = graph_build.stats(nodes, es, canonical).first()
    assert (s.n_nodes, s.n_edges, s.n_names, s.n_merged) == (2, 3, 3, 1)


def test_cooccurrence_counts_and_caps(spark):
    rows = [("T1", e, i) for i, e in enumerate("abc")] + [("T2", "a", 0), ("T2", "b", 1), ("T2", "a", 2)] + [("T3", f"e{i:02}", i) for i in range(20)]
    got = {(r.head, r.tail): (r.n_tasks, r.weight, r.source_task) for r in graph_build.cooccurrence(spark.createDataFrame(rows, "task string, entity string, pos int")).collect()}
    assert got["a", "b"] == (2, 2 / 3, "T2") and got["a", "c"][0] == 1 and sum(k[0].startswith("e") for k in got) == 105


def test_clean_triples(spark):
    t = spark.createDataFrame([(" a ", "r", "b", 2.0), ("系统", "r", "b", 1.0), ("a", " ", "b", 1.0), ("a", "r", None, 1.0), ("a", "r", "b", None), ("a", "r", "b", -1.0)], "head string, relation string, tail string, confidence double")
    assert sorted((r.head, r.confidence) for r in graph_build.clean_triples(t).collect()) == [("a", 0.0), ("a", 0.5), ("a", 1.0)]


def nodes(spark, *ns):
    return spark.createDataFrame([(n, list(a), list(t), len(t)) for n, a, t in ns], "name string, aliases array<string>, source_tasks array<string>, task_count int")


def test_ranked_search(spark):
    df = nodes(spark, ("abc", [], "1"), ("ABCDE", [], "1"), ("x", ["abc"], "1"), ("yy", ["abcd"], "1"), ("zabc", [], "1"), ("w", ["zzabc"], "12"), ("no", [], "1"), ("a%c", [], "1"))
    assert [(r.name, r["rank"]) for r in graph_query.search_ranked(df, " abc ").collect()] == [("abc", 0), ("ABCDE", 1), ("x", 2), ("yy", 3), ("zabc", 4), ("w", 5)]
    assert [r.name for r in graph_query.search_ranked(df, "a%c").collect()] == ["a%c"]
    assert graph_query.search_ranked(df, "  ").count() == 0 and graph_query.search_ranked(df, "a", -5).count() == 1


def test_exact_search(spark):
    df = nodes(spark, ("Attention", [], "1"), ("flashattention", [], "12"), ("self attention", [], "123"), ("other", ["ATTENTION"], "1234"), ("自注意力层", [], "1"), ("a.b", [], "1"))
    assert [r.name for r in graph_query.search_exact(df, "attention").collect()] == ["other", "Attention"]
    assert [r.name for r in graph_query.search_exact(df, "attention", mode="word").collect()] == ["other", "self attention", "Attention"]
    assert graph_query.search_exact(df, "注意力", mode="word").count() == 0
    assert [r.name for r in graph_query.search_exact(df, "a.b", mode="word").collect()] == ["a.b"]


def test_edges_and_self_loop(spark):
    e = edges(spark, ("a", "r", "a", 1, "T"), ("a", "r", "b", 1, "T"), ("c", "r", "a", 1, "T"))
    assert [graph_query.get_edges(e, "a", d).count() for d in ("out", "in", "both")] == [2, 2, 4]


def test_bfs(spark):
    e = edges(spark, ("a", "r", "b", 1, "T"), ("c", "r", "b", 1, "T"), ("c", "r", "d", 1, "T"), *[("h", "r", f"x{i}", 1, "T") for i in range(9)])
    reach = lambda s, **k: {r.name: r.hop for r in graph_query.bfs(e, seeds(spark, *s), **k).collect()}
    assert reach(["a"], depth=2) == {"a": 0, "b": 1, "c": 2}
    assert reach(["a"], depth=9) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert reach(["h"], depth=1, max_nodes=4) == {"h": 0, "x0": 1, "x1": 1, "x2": 1}
    assert reach(["a", "h", "zz"], depth=3, max_nodes=3) == {"a": 0, "h": 0, "zz": 0}
    assert reach([], depth=1) == {}


def test_trace(spark):
    cats = spark.createDataFrame([("uses", "x"), ("drops", "y")], "relation string, category string")
    e = edges(spark, ("a", "uses", "b", 0.5, "T1"), ("a", "uses", "b", 0.9, "T2"), ("b", "drops", "c", 1, "T3"), ("b", "likes", "d", 1, "T4"), ("a", "uses", "a", 1, "T5"))
    got = {(r.entity, r.related, r.direction, r.hop): r.weight for r in graph_query.trace(e, cats, "a", 2).collect()}
    assert got == {("a", "b", "out", 1): 0.9, ("b", "a", "in", 2): 0.9, ("b", "c", "out", 2): 1.0, ("a", "a", "out", 1): 1.0, ("a", "a", "in", 1): 1.0}
    assert graph_query.trace(e, cats, "unknown", 2).count() == 0
    assert sum(map(len, graph_query.DECISIONS.values())) == 24


def test_prune_and_isolates(spark):
    n = nodes(spark, *[(c, [], "") for c in "abcd"])
    e = edges(spark, ("a", "r", "b", 1, "T"), ("a", "r", "c", 1, "T"), ("b", "r", "a", 0.5, "T"))
    kept, left = graph_query.prune(n, e, 2)
    assert {r.name for r in kept.collect()} == {"a", "b"} and left.count() == 2
    assert {r.name for r in graph_query.without_isolates(n, e).collect()} == {"a", "b", "c"}
    assert [r.width for r in graph_query.visual_scale(n, e)[1].where("weight < 1").collect()] == [2.5]


def test_graph_sinks(spark, tmp_path):
    e = edges(spark, ("a", "r", "b", 1, "T")).withColumn("extraction_mode", F.lit("triple"))
    g = graph_build.Graph(nodes(spark, ("a", [], "1")), spark.createDataFrame([("a", "1")], "name string, task string"), e)
    for _ in range(2):
        graphs.write_graph(g, str(tmp_path / "g"), "triple")
    graphs.write_graph(g, str(tmp_path / "g"), "entity")
    names = spark.createDataFrame([("a", "concept"), ("b", "concept")], "name string, entity_type string")
    graphs.write_entities(g, names, spark.createDataFrame([("b", "a")], "name string, canonical string"), str(tmp_path / "e"))
    assert {r.name: r.canonical_name for r in spark.read.json(str(tmp_path / "e/entities.json")).collect()} == {"a": "a", "b": "a"}
    assert spark.read.json(str(tmp_path / "e/entity_tasks.json")).first().task == "1"
    assert spark.read.parquet(str(tmp_path / "g/edges")).groupBy("extraction_mode").count().collect().__len__() == 2
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 2
    doc = {"nodes": [{"id": "a", "entity_type": "t", "aliases": [], "source_tasks": ["T"]}], "links": [{"source": "a", "target": "a", "relation": "r", "weight": 1.0, "source_task": "T"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    read = graphs.read_node_link(spark, str(tmp_path / "g.json"))
    assert (read.nodes.first().name, read.tasks.first().task, read.edges.first().tail) == ("a", "T", "a")


def test_html_tables(spark):
    page = "<h2>Prices</h2><table><tr><th>Name</th><th>Model ID</th></tr><tr><td>A</td><td>a-1</td></tr><tr><td>B</td><td>b-1</td></tr></table><h2>Other</h2><table><tr><td>x</td></tr></table>"
    rows = html_tables.read_tables(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    assert [r.value for r in html_tables.column_of(rows, "Price", "ModelID").orderBy("row_no").collect()] == ["a-1", "b-1"]
    ends = spark.createDataFrame([("A", "a-1"), ("B", "b-1")], "label string, model string")
    prices = spark.createDataFrame([("A", "Free", "Free"), ("B", "Free", "1")], "label string, input string, output string")
    assert [r.model for r in html_tables.free_models(ends, prices).collect()] == ["a-1"]


@pytest.mark.parametrize("version, want", [(1, {"a": "reused", "b": "rechunked", "c": "new", "d": "stale"}), (2, {"a": "rechunked", "b": "rechunked", "c": "new", "d": "stale"})])
def test_incremental_decision(spark, version, want):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "session_id string, turns_hash string")
    old = spark.createDataFrame([("a", "1", 1), ("b", "x", 1), ("d", "4", 1)], "session_id string, turns_hash string, chunker_version int")
    assert {r.session_id: r.decision for r in incremental.decide(now, old, version=version).collect()} == want


def test_downstream_and_orphans(spark):
    deps = spark.createDataFrame([("p2", "p1"), ("p3", "p2"), ("p4", "p3"), ("p5", "p2"), ("x", "y")], "phase string, needs string")
    got = {r.name: r.hop for r in incremental.downstream(deps, seeds(spark, "p2")).collect()}
    assert got == {"p2": 0, "p3": 1, "p5": 1, "p4": 2}
    art = spark.createDataFrame([("f", "p4"), ("g", "p1")], "name string, phase string")
    assert [r.name for r in incremental.orphans(art, deps, seeds(spark, "p2")).collect()] == ["f"]
