import pytest
from loomgraph import config, prompts, service
from loomgraph.hooks import Hooks, equal_names, hashed_embedder
from loomgraph.operators import graph_build, quality, sessions, tasks
from loomgraph.plans import search
from pyspark.sql import functions as F


@pytest.fixture
def served(spark):
    hooks = Hooks()
    t = spark.createDataFrame([("T0", "s", "l0", "kafka stream setup", "2024-01-01", ["c0"]), ("T1", "s", "l1", "postgres index", "2024-01-02", ["c1"]), ("T2", "u", "l2", "kafka broker tuning", "", ["c2"])], "task string, session string, label string, summary string, created_at string, chunk_ids array<string>")
    t = t.withColumn("embedding", hooks.embed(F.col("summary")))
    chunks = spark.createDataFrame([(f"c{i}", f"T{i}", s, s + " in full") for i, s in enumerate(["kafka stream", "postgres", "kafka broker"])], "chunk string, task string, summary string, content string")
    nodes = spark.createDataFrame([("kafka", ["Apache Kafka"], 2), ("postgres", [], 1)], "name string, aliases array<string>, task_count int").withColumn("entity_type", F.lit("tool"))
    of = spark.createDataFrame([("kafka", "T0"), ("kafka", "T2"), ("postgres", "T1")], "name string, task string")
    edges = spark.createDataFrame([("kafka", "uses", "postgres", 0.9, "T0", "triple")], "head string, relation string, tail string, weight double, source_task string, extraction_mode string")
    cats = spark.createDataFrame([("uses", "chosen")], "relation string, category string")
    return service.Service(search.Corpus(t, chunks, hooks), graph_build.Graph(nodes, of, edges), cats)


def test_tools(served):
    assert set(served.tools()) == set(served.TOOLS) and served.tools()["query_kg"] == ["entity", "depth", "max_nodes"]
    assert served.health() == {"tasks": True, "graph": True}
    with pytest.raises(KeyError):
        served.call("drop_all")
    assert {r.task for r in served.call("query_kg", entity="kafka", depth=1).collect()} == {"T0", "T1", "T2"}
    assert [r.name for r in served.call("search_entities", query="KAF").collect()] == ["kafka"]
    assert [r.direction for r in served.call("get_entity_info", name="postgres").collect()] == ["in"]
    assert served.call("get_kg_stats").first().n_edges == 1
    assert [(r.related, r.category) for r in served.call("trace_decision", entity="kafka", max_hops=1).collect()] == [("postgres", "chosen")]
    assert [(r.session, r.n_tasks, r.last_at) for r in served.call("list_sessions").collect()] == [("s", 2, "2024-01-02"), ("u", 1, None)]
    assert [r.task for r in served.call("get_session_tasks", session="s").collect()] == ["T0", "T1"]


def test_search_tools(served):
    assert served.call("graph_rag_search", query="kafka broker", top_k=2).orderBy("rank").first().doc == "T2"
    assert {r.doc for r in served.call("summarize", query="kafka broker", level="full").collect()} == {"T0", "T1", "T2"}
    plain = service.Service(served.corpus)
    assert plain.call("summarize", query="postgres index", top_k=1).first().doc == "T1"
    sections = {r.entity: (r.tasks, r.hints) for r in served.call("skeleton_summarize", topic="the kafka topic").collect()}
    assert sections == {"kafka": (["T2", "T0"], ["uses postgres"]), "postgres": (["T1"], ["uses kafka"])}
    assert service.resolve_topic(served.graph.nodes, "zzz") is None


def test_context(served):
    got = service.build_context(served.graph, served.corpus.tasks, "How is Kafka set up?")
    assert [r.task for r in got.collect()] == ["T0", "T1", "T2"]


def test_config():
    c = config.from_nested({"search": {"graph_weight": 0.5, "other": 1}, "max_tasks": 3})
    assert (c.graph_weight, c.max_tasks, c.outer_rrf_k) == (0.5, 3, 30)
    assert config.get({"a": {"b": 1}}, "a.b") == 1 and config.get({"a": 1}, "a.b", 2) == 2
    assert config.put({"a": 1}, "a.b", 2) == {"a": {"b": 2}} and config.put({}, "x", 1) == {"x": 1}


def test_prompts():
    assert prompts.render("merge", a="x", b="y").endswith("x\ny")
    assert prompts.read_markdown("# one\n\n```text\nhello $you\n```\n## not this one\n```\nx\n```") == {"one": "hello $you"}
    assert prompts.render("one", {"one": "hello $you"}, you="A") == "hello A"


def test_alignment_embeds_new_names_only(spark):
    names = spark.createDataFrame([("Web-Server",), ("web server",), ("database",)], "name string")
    cache = spark.createDataFrame([("database", [9.0] + [0.0] * 63), ("old", [1.0] * 64)], "name string, embedding array<double>")
    vectors = graph_build.embed_new(names, cache, hashed_embedder)
    got = {r.name: r.embedding[0] for r in vectors.collect()}
    assert set(got) == {"Web-Server", "web server", "database"} and got["database"] == 9.0
    assert {r.name: r.canonical for r in graph_build.align(names, vectors, equal_names).collect()} == {"Web-Server": "Web-Server", "web server": "Web-Server", "database": "database"}


def test_prompt_budget(spark):
    kind = "array<struct<type:string,summary:string,ok:boolean,error:string>>"
    rows = [("s", 1, i, "u" * 200, ["a" * 2000], [], []) for i in range(3)] + [("s", 2, 9, "q", [], [], [])]
    df = spark.createDataFrame(rows, f"session_id string, batch_id int, turn_index int, user_message string, assistant_messages array<string>, tool_calls {kind}, mcp_calls {kind}")
    got = {r.batch_id: r for r in tasks.format_prompts(df, budget=1200).collect()}
    assert got[2].prompt == "--- c9 ---\n[User]\nq\n" and got[1].tokens <= 1200 and got[1].prompt.count("---") >= 6 and "TRUNCATED" in got[1].prompt


def test_model_calls_are_tried_again(spark):
    def model(prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return '{"a": 1}' if prompt == "fine" else "no json"

    got = {r.prompt: (r.reply, r.attempts, r.error) for r in tasks.call_model(spark.createDataFrame([("fine",), ("boom",), ("odd",)], "prompt string"), model, attempts=2, wait=0).collect()}
    assert got == {"fine": ('{"a": 1}', 1, None), "boom": (None, 2, "down"), "odd": (None, 2, "the reply is not valid")}


def test_inspection(spark):
    old = spark.createDataFrame([("k1", "c1"), ("k2", "c2")], "key string, chunk string")
    new = spark.createDataFrame([("k1", "c1"), ("k1", "c3"), ("bad", "c3")], "key string, chunk string")
    r = quality.verify_rerun(old, new, "key", "chunk", F.col("key") == "bad").first()
    assert (r.n_repeated, r.n_lost, r.n_added, r.n_bad) == (1, 1, 1, 1)
    assert quality.sample_rows(spark.range(100), 7, 1).count() == 7
    stats = {r.name: (r.n_rows, r.dim) for r in quality.collection_stats(a=old, b=spark.createDataFrame([([1.0, 2.0],)], "embedding array<double>")).collect()}
    assert stats == {"a": (2, None), "b": (1, 2)}
    hits = spark.createDataFrame([(True, True), (False, False)], "drift boolean, nominal boolean")
    pairs = spark.createDataFrame([(False,)], "is_near boolean")
    facts = quality.conclusions(hits, pairs, spark.createDataFrame([("x" * 60,)], "summary string"), spark.createDataFrame([(None,)], "task string"))
    assert {r.fact: r.n for r in facts.collect()} == {"drift": 1, "no hit": 1, "chunks without a task": 1}


def test_fingerprints_follow_content(spark):
    turns = lambda text: spark.createDataFrame([("s", 0, "user", "a"), ("s", 1, "assistant", text), ("s", 2, "user", "b"), ("s", 3, "assistant", "c")], "session_id string, turn_no int, role string, content string")
    mark = lambda text: sessions.session_fingerprint(sessions.chunk_sessions(turns(text))).first().fingerprint
    assert mark("x") == mark("x") != mark("y")
