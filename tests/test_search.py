import math

import pytest
from loomgraph.functions import text
from loomgraph.hooks import Hooks
from loomgraph.operators import bm25, dense, fusion, quality, sparse, summary
from loomgraph.plans import search
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


def docs(spark, **d):
    return spark.createDataFrame([(k, v) for k, v in d.items()], "doc_id string, text string")


def queries(spark, *ts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "query_id int, text string")


def brute(corpus, query):
    ws = {d: t.lower().split() for d, t in corpus.items() if t and t.split()}
    n, avg = len(ws), sum(map(len, ws.values())) / len(ws)
    df = {t: sum(t in w for w in ws.values()) for w in ws.values() for t in w}
    idf = {t: math.log((n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    out = {d: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in query.lower().split() if t in w) for d, w in ws.items()}
    return {d: s for d, s in out.items() if s > 0}


def test_bm25_equals_brute_force(spark):
    corpus = {"a": "x y z", "b": "x x w", "c": "x q", "d": "", "e": "u v w x y"}
    for q in ("x", "x x y", "w y", "nothing"):
        got = {r.doc: r.score for r in bm25.search(docs(spark, **corpus), queries(spark, q)).collect()}
        want = brute(corpus, q)
        assert set(got) == set(want) and all(math.isclose(got[d], want[d]) for d in want)


def test_bm25_ties_go_to_the_smaller_id(spark):
    assert [r.doc for r in bm25.search(docs(spark, b="k m", a="k m", c="z", d="z2", e="z3"), queries(spark, "k"), 1).collect()] == ["a"]


def test_bm25_of_repeated_ids(spark):
    """Rows that share an id add up: as one document where their lengths are equal too, as two postings of a term else."""
    rows = [("a", "x y z"), ("a", "x w v"), ("a", "x"), ("b", "x u"), ("c", "u w"), ("d", "p q r s"), ("e", None), ("f", "q")]
    index = bm25.build(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted((r.doc, r.term, r.tf, r.dl) for r in index.postings.collect() if r.term == "x") == [("a", "x", 1, 1), ("a", "x", 2, 3), ("b", "x", 1, 2)]
    assert (index.n_docs, {r.term: r.df for r in index.terms.collect()}["x"]) == (7, 3)
    raw = math.log(4.5 / 3.5)
    gain = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (16 / 7)))
    got = {r.doc: r.score for r in bm25.best(index, bm25.query_terms(queries(spark, "x")), 5).collect()}
    assert set(got) == {"a", "b"} and math.isclose(got["a"], raw * (gain(1, 1) + gain(2, 3))) and math.isclose(got["b"], raw * gain(1, 2))
    assert math.isclose(bm25.token_idf(index, queries(spark, "x").select(F.col("text").alias("term"))).first().idf_proxy, raw * max(gain(1, 1), gain(2, 3), gain(1, 2)))


def sparse_case():
    import random

    draw = random.Random(5)
    points = [(f"d{i:03}", {f"t{draw.randrange(30)}": float(draw.randrange(-1, 4)) for _ in range(draw.randrange(9))}) for i in range(200)]
    points += [(f"z{i:03}", points[7][1]) for i in range(60)]
    asked = [(j, {f"t{draw.randrange(33)}": float(draw.randrange(1, 3)) for _ in range(6)}) for j in range(11)]
    want = []
    for j, x in asked:
        scored = sorted((-sum(w * y.get(t, 0.0) for t, w in x.items()), d) for d, y in points)
        want += [(j, d, -s, i + 1) for i, (s, d) in enumerate(r for r in scored[:4] if r[0] < 0)]
    return [(d, list(x), list(x.values())) for d, x in points], [(j, t, w) for j, x in asked for t, w in x.items()], sorted(want)


def test_only_the_best_rows_leave_a_task(spark, monkeypatch):
    points, asked, want = sparse_case()
    monkeypatch.setattr(sparse, "QUERY_BLOCK", 4)
    p = spark.createDataFrame(points, "doc string, terms array<string>, weights array<double>").repartition(3)
    found = sparse.candidates(p, spark.createDataFrame(asked, "query int, term string, weight double"), 4)
    assert found.count() <= 3 * 11 * 4
    assert sorted(map(tuple, bm25.top(found, 4).collect())) == want


@pytest.mark.parametrize("cells, common, full", [(50, 2, 40), (7, 1_000_000, 100), (4_000_000, 0.5, 1)])
def test_sparse_scores_in_pieces(monkeypatch, cells, common, full):
    import pyarrow as pa

    class Kept(sparse._Kept):
        def __init__(self, n, k):
            super().__init__(n, k)
            self.full = full

    points, asked, want = sparse_case()
    for name, value in (("_CELLS", cells), ("_COMMON", common), ("_Kept", Kept)):
        monkeypatch.setattr(sparse, name, value)
    schema = StructType([StructField("query", IntegerType()), StructField("doc", StringType()), StructField("score", DoubleType())])
    rows = pa.table({c: pa.array([r[i] for r in points]) for i, c in enumerate(("doc", "terms", "weights"))})
    table = pa.table({"query": pa.array([r[0] for r in asked], pa.int32()), "term": [r[1] for r in asked], "weight": [r[2] for r in asked]})
    out = pa.Table.from_batches(sparse._best(4, lambda: table, schema)(iter(rows.to_batches(max_chunksize=90)))).to_pylist()
    assert sorted((r["query"], r["doc"], r["score"]) for r in out) == [r[:3] for r in want]


def ranked(spark, *ids):
    return spark.createDataFrame([(0, d, i + 1) for i, d in enumerate(ids)], "query int, doc string, rank int")


def order(df):
    return [r.doc for r in df.orderBy("rank").collect()]


def test_hierarchical_fusion(spark):
    inner = fusion.rrf(ranked(spark, "summary-only", "shared"), ranked(spark, "cleaned-only", "shared"), 1)
    assert order(inner) == ["shared", "summary-only", "cleaned-only"]
    assert order(fusion.rrf(ranked(spark, "dense-only"), inner, 1))[:2] == ["dense-only", "shared"]


@pytest.mark.parametrize("vector, graph, want", [(["T0", "T1", "T2"], [], {"T0": 0.7 / 61}), ([], ["T0"], {"T0": 0.3 / 61}), (["T0", "T1"], ["T0", "T1"], {"T0": 1 / 61, "T1": 1 / 62}), ([], [], {})])
def test_weighted_fusion(spark, vector, graph, want):
    got = {r.doc: r.score for r in fusion.weighted_rrf(ranked(spark, *vector), ranked(spark, *graph), 60).collect()}
    assert all(math.isclose(got[d], s) for d, s in want.items()) and set(got) == set(vector) | set(graph)


def test_weighted_fusion_at_the_ends(spark):
    zero = {r.doc: r.score for r in fusion.weighted_rrf(ranked(spark, "a"), ranked(spark, "b"), 60, 0.0).collect()}
    assert zero["b"] == 0 and zero["a"] > 0
    with pytest.raises(ValueError):
        fusion.weighted_rrf(ranked(spark, "a"), ranked(spark, "b"), 60, 1.5)
    assert order(fusion.weighted_rrf(ranked(spark, "T2", "T0", "T1"), ranked(spark), 60)) == ["T2", "T0", "T1"]


def test_chunks_roll_up_to_tasks(spark):
    hits = spark.createDataFrame([(0, "c1", 3.0, 1), (0, "c2", 2.0, 2), (0, "c3", 2.0, 3), (0, "c4", 1.0, 4)], "query int, doc string, score double, rank int")
    owners = spark.createDataFrame([("c1", "B"), ("c2", "A"), ("c3", "C"), ("c4", None)], "chunk string, task string")
    tasks = spark.createDataFrame([("A",), ("B",)], "task string")
    assert [(r.doc, r.score) for r in fusion.chunks_to_tasks(hits, owners, tasks).orderBy("rank").collect()] == [("B", 3.0), ("A", 2.0)]


def test_last_owner_holds(spark):
    t = spark.createDataFrame([("A", 0, ["c1", "c2"]), ("B", 1, ["c2"])], "task string, pos int, chunk_ids array<string>")
    assert {r.chunk: r.task for r in fusion.chunk_to_task(t).collect()} == {"c1": "A", "c2": "B"}


def test_dense_and_sparse(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])], "doc_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<float>")
    assert [(r.doc, round(r.score, 4)) for r in dense.search(p, q).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.7071), ("c", 0.0)]
    w = spark.createDataFrame([("a", 5, 1.0), ("a", 5, 3.0), ("a", 2, 9.0), ("b", 5, 2.0)], "doc string, token int, weight double")
    pooled = dense.max_pool(w)
    assert sorted((r.doc, r.token, r.weight) for r in pooled.collect()) == [("a", 5, 3.0), ("b", 5, 2.0)]
    assert [(r.doc, r.score) for r in dense.sparse_search(pooled, spark.createDataFrame([("q", 5, 2.0)], "query string, token int, weight double")).orderBy("rank").collect()] == [("a", 6.0), ("b", 4.0)]


@pytest.mark.parametrize("sizes, want", [([5000, 7000, 10], [(1, 5000, False), (2, 7000, False)]), ([11801, 500], [(1, 11801, False)]), ([11800, 500], [(1, 11800, False), (2, 200, True)]), ([13000, 5], [(1, 12000, True)]), ([0, 12000, 0], [(1, 0, False), (2, 12000, False), (3, 0, False)])])
def test_budget_packing(spark, sizes, want):
    items = spark.createDataFrame([(0, i + 1, t) for i, t in enumerate(sizes)], "query int, rank int, tokens int")
    assert [(r["rank"], r.used_tokens, r.truncated) for r in summary.pack(items).orderBy("rank").collect()] == want


def test_sections_claim_tasks_once(spark):
    claims = spark.createDataFrame([("topic", "T1"), ("b", "T1"), ("b", "T2"), ("a", "T2"), ("a", "T1")], "entity string, task string")
    assert sorted((r.entity, r.task) for r in summary.sections(claims, "topic").collect()) == [("a", "T2"), ("topic", "T1")]


def corpus(spark, hooks=None):
    tasks = spark.createDataFrame([(f"T{i}", f"l{i}", s, f"2024-01-0{i + 1}", [f"c{i}"], v) for i, (s, v) in enumerate([("red apple pie", [1.0, 0.0]), ("green pear", [0.0, 1.0]), ("blue sky apple", [0.7, 0.7])])], "task string, label string, summary string, created_at string, chunk_ids array<string>, embedding array<double>")
    chunks = spark.createDataFrame([("c0", "T0", "apple pie", "long text of apple pie"), ("c1", "T1", "", "pear text"), ("c2", "T2", "sky", "sky and apple")], "chunk string, task string, summary string, content string")
    return search.Corpus(tasks, chunks, hooks or Hooks())


def test_search_end_to_end(spark):
    c = corpus(spark)
    q = spark.createDataFrame([("q", "apple pie", [1.0, 0.0])], "query string, text string, embedding array<double>")
    got = search.search(c, q, top_k=2).orderBy("rank").collect()
    assert [r.doc for r in got] == ["T0", "T2"] and got[0].score == 1.0 and got[0].chunks[0].chunk == "c0"
    assert search.search(c, q, top_k=2, skip_rerank=True).count() == 3
    kept = search.summarize(search.rerank(search.candidates(c, q), q, c.tasks, c.hooks, 3), c.tasks, c.chunks, "full", 12000, since="2024-01-02", until=None)
    assert {r.doc for r in kept.collect()} == {"T1", "T2"}


def test_graph_rag(spark):
    from loomgraph.operators import graph_build, graph_query

    nodes = spark.createDataFrame([("A", [], 2), ("B", [], 5), ("C", [], 1)], "name string, aliases array<string>, task_count int")
    of = spark.createDataFrame([("A", "T0"), ("A", "T1"), *[("B", f"T{i}") for i in range(5)], ("C", "T2")], "name string, task string")
    edges = spark.createDataFrame([("A", "r", "B", 1.0, "T0")], "head string, relation string, tail string, weight double, source_task string")
    tasks = spark.createDataFrame([(f"T{i}",) for i in range(5)], "task string")
    seeds = spark.createDataFrame([("q", "A")], "query string, name string")
    graph = graph_build.Graph(nodes, of, edges)
    ranks = search.graph_ranks(graph, tasks, seeds)
    a, b = math.log(1 + 5 / 2), math.log(2)
    assert {r.doc: round(r.score, 9) for r in ranks.collect()} == {"T0": round(a + b, 9), "T1": round(a + b, 9), "T2": round(b, 9), "T3": round(b, 9), "T4": round(b, 9)}
    vector = spark.createDataFrame([("q", f"T{i}", i + 1) for i in range(3)], "query string, doc string, rank int")
    assert {r.source: r.n for r in fusion.source_distribution(fusion.weighted_rrf(vector, ranks)).collect()} == {"both": 3, "graph": 2}
    assert graph_query.anti_idf(graph, spark.createDataFrame([("A",)], "name string"), tasks.limit(0)).count() == 0


def test_alias_expansion(spark):
    d = docs(spark, **{f"d{i}": t for i, t in enumerate(["kafka stream", "log store", "queue broker", "other words", "more words here"])})
    nodes = spark.createDataFrame([("Kafka", ["event bus", "Apache Kafka", "third"], 5), ("Zed", ["nothing"], 9)], "name string, aliases array<string>, task_count int")
    q = spark.createDataFrame([("q", "kafka log")], "query string, text string")
    assert sorted(r.term for r in search.expand_query(bm25.build(d), nodes, q).collect()) == ["apache", "bus", "event", "kafka", "log"]
    assert sorted(r.term for r in search.expand_query(bm25.build(d), nodes.limit(0), q).collect()) == ["kafka", "log"]


def test_names_in_long_texts(spark, monkeypatch):
    texts = [(1, "The BUILDING stands. " + "Ünder 😀x" * 20_000), (2, "no building? machinery"), (2, "under😀X it"), (3, None), (4, "")]
    q = spark.createDataFrame(texts, "query int, text string")
    nodes = spark.createDataFrame([("Building",), ("x",), ("ünder",), ("😀x",), ("absent",), ("Building",)], "name string")
    want = sorted((i, n) for i, n in {(i, n) for i, t in texts for n in ("Building", "ünder", "😀x", "absent") if n.lower() in (t or "").lower()})
    monkeypatch.setattr(search, "NAMES_EACH", 0)
    assert sorted(map(tuple, search.dictionary_entities(q, nodes).collect())) == want
    monkeypatch.undo()
    monkeypatch.setattr(search, "_grams", None)  # a few names need no list of a text's parts
    assert sorted(map(tuple, search.dictionary_entities(q, nodes).collect())) == want


def test_query_prefix(spark):
    r = spark.createDataFrame([("q",)], "t string").select(text.retrieval_query("t", "find: ").alias("a"), text.retrieval_query("t").alias("b")).first()
    assert (r.a, r.b) == ("find: q", "q")


def test_retrieval_hits(spark):
    r = spark.createDataFrame([("q", f"T{i}", i) for i in range(1, 8)], "query string, doc string, rank int")
    t = spark.createDataFrame([(f"T{i}", "label" if i < 6 else "KEY", "has key" if i == 2 else "") for i in range(1, 8)], "doc string, label string, summary string")
    k = spark.createDataFrame([("q", "key")], "query string, word string")
    got = quality.retrieval_hits(r, t, k).first()
    assert (got.nominal, got.effective, got.drift) == (True, False, True)


def test_many_queries_go_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]
    p = spark.createDataFrame(rows, "doc_id int, embedding array<double>")
    q = p.withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, dense.search(p, q, 3).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, dense.search(p, q, 3).collect())) == whole


def test_numbered_counts_over_all_ranges(spark):
    from loomgraph.sources import tables

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert sorted((r.v, r.n) for r in tables.numbered(df, "v").collect()) == [(i, i) for i in range(1000)]
