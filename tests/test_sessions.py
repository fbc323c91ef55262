import json

import pytest
from loomgraph.functions import text
from loomgraph.operators import sessions, tasks
from loomgraph.sources import sessions as source
from pyspark.sql import functions as F

CALLS = "array<struct<type:string,cmd:string,action:string,target:string,ok:boolean,output:string,error:string>>"


def call(kind="bash", **k):
    return {"type": kind, "cmd": None, "action": None, "target": None, "ok": True, "output": None, "error": None} | k


def turns(spark, *rows):
    """rows: (session, role, content[, calls[, output]])"""
    full = [(r[0], i, r[1], r[2], r[3] if len(r) > 3 else [], r[4] if len(r) > 4 else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, f"session_id string, turn_no int, role string, content string, tool_calls {CALLS}, output string")


def merged(df):
    return {(r.session_id, r.turn_index): (r.user_message, r.assistant_messages) for r in sessions.merge_chunks(sessions.raw_chunks(df)).collect()}


def test_leading_turns_go_and_answers_are_collected(spark):
    df = turns(spark, ("s", "system", "x"), ("s", "assistant", "y"), ("s", "user", " a "), ("s", "assistant", "b"), ("s", "tool_result", "", [], "out"), ("s", "user", "c"), ("s", "assistant", "d"))
    assert merged(df) == {("s", 1): (" a ", ["b", "[Tool Result] out"]), ("s", 2): ("c", ["d"])}


def test_unanswered_messages_join_the_next_answer(spark):
    df = turns(spark, *[("s", "user", t) for t in (" a", "a ", "a", "b")], ("s", "assistant", "x"), ("s", "user", "c"), ("s", "user", "d "))
    assert merged(df) == {("s", 1): ("a\n\nb", ["x"]), ("s", 2): ("c\n\nd", [])}


def test_a_single_chunk_stays_as_it_is(spark):
    assert merged(turns(spark, ("s", "user", " a "))) == {("s", 1): (" a ", [])}


def test_a_chunk_with_a_call_only_is_answered(spark):
    df = turns(spark, ("s", "user", "a"), ("s", "assistant", "", [call(cmd="ls")]), ("s", "user", "b"), ("s", "assistant", "x"))
    assert set(merged(df)) == {("s", 1), ("s", 2)}


def test_clean_chunks(spark):
    df = turns(spark, ("s", "user", "a"), ("s", "assistant", "b", [call(cmd=""), call("mcp_call", target="t", ok=False, error="e" * 300), call("tool_call", action="act")]))
    r = sessions.clean_chunks(sessions.merge_chunks(sessions.raw_chunks(df))).first()
    assert [c.summary for c in r.tool_calls] == ["(empty cmd)", "act"]
    assert r.mcp_calls[0].summary == "t" and r.mcp_calls[0].error == "e" * 200 + "...[truncated, total 300 chars]"
    assert r.cleaned_text.startswith("[User]\na\n\n[Assistant]\nb\n\n[Tool:bash] (empty cmd) [OK]\n")


def test_mock_sessions_filter(spark):
    _, t = source.mock_sessions(spark)
    chunks = sessions.chunk_sessions(t)
    assert sorted((r.session_id, r.turn_index, len(r.mcp_calls)) for r in chunks.collect()) == [("mock_a", 1, 0), ("mock_a", 2, 0), ("mock_b", 1, 0), ("mock_b", 2, 1)]


@pytest.mark.parametrize(
    "said, want",
    [("/init --flag", "/init"), ("  @src/a.py look", "@src/a.py"), ("/Users/a/b.yaml what", "/Users/a/b.yaml what"), ("<auto-slash-command>\n# /go Command\nlong", "/go"), ("<auto-slash-command> then /do it", "/do"), ("plain", "plain"), ("", "")],
)
def test_collapse_command(spark, said, want):
    assert spark.createDataFrame([(said,)], "t string").select(text.collapse_command("t")).first()[0] == want


def chunk(spark, user, assistant, kinds=()):
    calls = [{"type": k, "summary": "s" * 100, "ok": True, "error": None} for k in kinds if k != "mcp_call"]
    mcps = [{"type": k, "summary": "m" * 100, "ok": True, "error": None} for k in kinds if k == "mcp_call"]
    kind = "array<struct<type:string,summary:string,ok:boolean,error:string>>"
    return spark.createDataFrame([(user, assistant, calls, mcps)], f"u string, a array<string>, t {kind}, m {kind}")


@pytest.mark.parametrize("budget, stage", [(1000, 0), (330, 1), (230, 2), (140, 3), (90, 4)])
def test_truncation_stages(spark, budget, stage):
    df = chunk(spark, "hello", ["x" * 100], ["bash", "tool_call", "mcp_call"]).select(text.truncate_chunk("u", "a", "t", "m", budget).alias("r"))
    r = df.first().r
    assert r.stage == stage and int(len(r.text) * 0.75) <= budget and "hello" in r.text


def test_truncation_of_a_user_alone_over_budget(spark):
    r = chunk(spark, "u" * 1000, []).select(text.truncate_chunk("u", "a", "t", "m", 100).alias("r")).first().r
    assert r.stage == 4 and int(len(r.text) * 0.75) <= 100 and "TRUNCATED" in r.text


def test_safe_truncate_never_gives_none(spark):
    r = spark.createDataFrame([("a" * 500,)], "t string").select(text.safe_truncate("t", 30).alias("a"), text.safe_truncate("t", 1000).alias("b")).first()
    assert r.a and int(len(r.a) * 0.75) <= 30 and r.b == "a" * 500


def test_entity_types(spark):
    names = {"main.py": "file", "fix it": "bug", "prefix": "concept", "登录错误": "bug", "build tool": "tool", "my repo": "project", "auth service": "module", "Alice Li": "person", "Deep Learning": "concept", "王小明": "person", "数据库": "concept", " ": "concept"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.entity_type("n").alias("t")).collect()
    assert {r.n: r.t for r in got} == names


def test_time_range(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02T00:00:00",), ("2024-01-02T10:00:00",), ("bad",), (None,)], "t string")
    n = lambda a, b: df.where(text.in_time_range("t", a, b)).count()
    assert [n("2024-01-01", "2024-01-02"), n(None, "2024-01-01"), n("2024-01-02", None), n("what", "2024-01-02"), n(None, None)] == [2, 1, 2, 5, 5]


def test_json_sources(spark, tmp_path):
    lines = [{"id": "a", "type": "", "messages": [{"text": "hi", "tool_calls": [{"type": "", "command": "ls", "success": False}]}, {"role": "assistant", "content": "", "text": "yo"}]}, {"id": "b", "turns": [{"role": "user", "content": "x"}]}]
    (tmp_path / "s.jsonl").write_text(json.dumps(lines[0]) + "\n\nnot json\n" + json.dumps(lines[1]) + "\n")
    s, t = source.sessions_from_json(spark, str(tmp_path / "s.jsonl"))
    assert sorted((r.id, r.type) for r in s.collect()) == [("a", "root"), ("b", "root")]
    rows = {(r.session_id, r.turn_no): r for r in t.collect()}
    assert rows["a", 0].role == "user" and rows["a", 0].content == "hi" and rows["a", 1].content == "yo"
    c = rows["a", 0].tool_calls[0]
    assert (c.type, c.cmd, c.ok) == ("tool_call", "ls", False)
    (tmp_path / "s.json").write_text(json.dumps(lines))
    assert source.sessions_from_json(spark, str(tmp_path / "s.json"), multiline=True)[0].count() == 2


def test_raw_tables(spark):
    s = spark.createDataFrame([("a", None, "t", 1), ("b", "a", "t", 2), ("c", None, "t", 3)], "id string, parent_id string, title string, time_created long")
    m = spark.createDataFrame([("m1", "a", 1, '{"role":"user"}'), ("m2", "a", 2, '{"role":"assistant"}'), ("m3", "a", 3, '{"role":"user"}'), ("m4", "c", 1, '{"role":"user"}')], "id string, session_id string, time_created long, data string")
    part = [("m1", 1, '{"type":"text","text":"one"}'), ("m1", 2, '{"type":"text","text":"two"}'), ("m2", 1, '{"type":"tool","tool":"bash","state":{"status":"completed","input":{"command":"ls"},"output":"no","metadata":{"exit":1}}}'), ("m2", 2, '{"type":"tool","tool":"read","state":{"status":"completed","input":{"filePath":"f.py"}}}'), ("m3", 1, '{"type":"text","text":"<system-reminder>x</system-reminder> "}')]
    p = spark.createDataFrame(part, "message_id string, time_created long, data string")
    sess, t = source.turns_from_tables(s, m, p, min_user=1)
    rows = {(r.session_id, r.turn_no): r for r in t.collect()}
    assert set(rows) == {("a", 0), ("a", 1)} and rows["a", 0].content == "one\ntwo"
    bash, read = rows["a", 1].tool_calls
    assert (bash.type, bash.cmd, bash.ok, bash.error) == ("bash", "ls", False, "no") and (read.action, read.ok) == ("read: f.py", True)
    assert [r.id for r in sess.collect()] == ["a"]
    assert source.turns_from_tables(s, m, p, min_user=2)[0].count() == 0
    assert source.turns_from_tables(s, m, p, min_user=2, count_raw=True)[0].count() == 1


def test_source_precedence():
    assert source.source_of("db", True, "f") == ("tables", "db")
    assert source.source_of(None, True, "f") == ("mock", None)
    assert source.source_of(None, False, "f", {"mock_data": True}) == ("json", "f")
    assert source.source_of(config={"mock_data": True, "source": "g"}) == ("mock", None)


def plan(sizes, size=16, budget=30_000):
    out, i, n = [], 0, 0
    while i < len(sizes):
        m, n = min(size, len(sizes) - i), n + 1
        while m > 1 and sum(s + 250 for s in sizes[i : i + m]) > budget:
            m = -(-m // 2)
        out += [n] * m
        i += m
    return out


def test_batch_plan(spark):
    cases = {"a": [100] * 40, "b": [5000] * 20, "c": [40_000, 1, 29_000, 900, 40_000], "d": [], "e": [2000, 10, 10, 9000] * 8}
    rows = [(k, i, t) for k, v in cases.items() for i, t in enumerate(v)]
    got = {(r.session_id, r.turn_index): r.batch_id for r in tasks.plan_batches(spark.createDataFrame(rows, "session_id string, turn_index int, tokens int")).collect()}
    assert got == {(k, i): b for k, v in cases.items() for i, b in enumerate(plan(v))}


@pytest.mark.parametrize(
    "reply, want",
    [('{"a":1}', '{"a":1}'), ('x ```json\n{"a": [1]}\n``` y', '{"a":[1]}'), ('so: {"a": 1} and {"b": [1, 2, 3, 4]}', '{"b":[1,2,3,4]}'), ('{"a": [1, 2, {"b": "c', '{"a":[1,2,{"b":"c"}]}'), ('{"a": 1, "b', '{"a":1}'), ("none", None), ("", None)],
)
def test_json_repair(reply, want):
    assert tasks.extract_json(reply) == want


@pytest.mark.parametrize(
    "reply, want",
    [
        ('```json\n{"head":{"doc_id":10000,"lang":"en"},"tail":["src3","en"', '{"head":{"doc_id":10000,"lang":"en"},"tail":["src3","en"]}'),
        ('{"a":{"long":"enough to be half"},"b', '{"a":{"long":"enough to be half"}}'),
        ('see [x, y: {"a": 1, "b": [2, 3]} there', '{"a":1,"b":[2,3]}'),
        ('[1, 2 or {"a": 1, "b": 2}', '{"a":1,"b":2}'),
    ],
)
def test_a_part_of_a_cut_off_reply_is_not_all_of_it(reply, want):
    assert tasks.extract_json(reply) == want


def test_ownership():
    import pandas as pd

    turn = {f"c{i}": i for i in range(1, 7)}
    own = lambda *rows: {t: sorted(g) for t, g in tasks.repair_owners(pd.DataFrame(rows, columns=["task_pos", "chunk_id"]), turn).groupby("task_pos")["chunk_id"].apply(list).items()}
    # c2 is nearest to c1; c3 and c4 follow it one after the other, as each one added counts for the next.
    assert own((0, "c1"), (0, "c2"), (1, "c2"), (1, "c5"), (1, "c6")) == {0: ["c1", "c2", "c3", "c4"], 1: ["c5", "c6"]}
    assert own((0, "c1"), (0, "c9"), (1, "c6")) == {0: ["c1", "c2", "c3", "c4", "c5"], 1: ["c6"]}
    assert own((0, "c1"), (0, "c3"), (1, "c3"), (1, None)) == {0: ["c1", "c2"], 1: ["c3", "c4", "c5", "c6"]}
    assert own((0, None)) == {0: sorted(turn)}


def test_chunk_parsers(spark):
    replies = spark.createDataFrame([(7, '```json\n{"tasks":[{"task_label":"l","task_summary":"s","chunk_ids":["c1","7_c2"]}]}\n```')], "session_id long, reply string")
    assert sorted(r.chunk_id for r in tasks.parse_tasks(replies).collect()) == ["7_c1", "7_c2"]
    t = spark.createDataFrame([("T1", 'ok {"triples":[{"head":"a","relation":"r","tail":"b","confidence":2}]}')], "task string, reply string")
    r = tasks.parse_triples(t).first()
    assert (r.head, r.tail, r.confidence, r.source_task) == ("a", "b", 2.0, "T1")


def test_stream_keeps_chunks_current(spark, tmp_path):
    from loomgraph.streaming import rechunk

    src, log, out, ck = (str(tmp_path / n) for n in ("in", "log", "out", "ck"))

    def add(n, rows):
        spark.createDataFrame(rows, rechunk.TURNS).coalesce(1).write.mode("append").json(src)
        rechunk.rechunk_stream(spark.readStream.schema(rechunk.TURNS).json(src), log, out, ck).awaitTermination()

    add(1, [("s", 0, "user", "a"), ("s", 1, "assistant", "b"), ("t", 0, "user", "q")])
    add(2, [("s", 2, "user", "c"), ("s", 3, "assistant", "d")])
    assert sorted((r.session_id, r.user_message) for r in rechunk.latest_chunks(spark, out).collect()) == [("s", "a"), ("s", "c"), ("t", "q")]
