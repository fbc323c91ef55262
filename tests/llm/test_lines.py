import gc
import time
from collections import defaultdict

import pyarrow as pa
import pytest
from loomgraph.llm import bpe, line_dedup, near_copies, toxicity

SPACE = " \t\n\v\f\r"


def slow(rows, least_chars=20, least_docs=3):
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(SPACE).translate(az)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least_docs or i == max(holders[key(x)])]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def rows_of(df):
    return {r.doc_id: (r.kept, r.n_lines, r.n_dropped) for r in df.collect()}


def dedup(df):
    return line_dedup.dedup_lines(df, names=("kept", "n_lines", "n_dropped"))


LONG = "A line of some twenty characters"


def test_equals_brute_force(wide):
    rows = [(1, f"{LONG}\nx\n {LONG.upper()}\t"), (2, f"y\n{LONG}"), (5, f"{LONG.lower()}\n\n{LONG}\nz"), (3, None), (4, ""), (6, "\n"), (7, "É" * 20 + "\nx"), (8, "É" * 20), (9, "é" * 20 + "\n" + "É" * 20), (10, "short\nshort"), (11, "short"), (12, "short"), (13, LONG + "\r\n" + "\u00a0" + LONG)]
    rows += [(i, "\n".join(f"line number {j} of many documents" for j in range(i % 7, 9))) for i in range(20, 40)]
    assert rows_of(dedup(wide(*rows))) == slow(rows)


def test_nulls_repeats_and_no_rows(wide):
    got = dedup(wide((None, LONG), (1, LONG), (1, LONG), (2, LONG))).collect()
    assert all(r.n_dropped == 0 and r.kept == LONG for r in got) and len(got) == 4  # two documents only
    assert dedup(wide()).count() == 0


def test_other_columns_stay(frame):
    schema = "n_lines int, doc_id long, gone string, text string, _lines string, row int, kept_text string, `a.b` int, of int, id int, n_dropped int, n_chars int"
    rows = [(7, i, "g", f"{LONG}\nown line {i}" if i else None, "l", 1, "old", 2, 3, 4, 5, 900) for i in range(4)]
    df = frame(schema, *rows)
    out = line_dedup.dedup_lines(df, names=("k", "n", "d"))
    assert out.columns == [*df.columns, "k", "n", "d"]
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert all(got[r[1]][: len(r)] == r for r in rows)
    assert [got[i][-3:] for i in range(4)] == [("", 1, 0), ("own line 1", 2, 1), ("own line 2", 2, 1), (f"{LONG}\nown line 3", 2, 0)]
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df)
    left = line_dedup.without_common_lines(df, chars_col="n_chars")
    assert left.columns == df.columns
    back = {r.doc_id: (r.text, r.n_chars, r.n_lines, r.kept_text) for r in left.collect()}
    assert back == {0: (None, 900, 7, "old"), 1: ("own line 1", 10, 7, "old"), 2: ("own line 2", 10, 7, "old"), 3: (f"{LONG}\nown line 3", 900, 7, "old")}


def test_very_long_texts(wide):
    began = time.time()
    text = "\n".join(f"a line that many texts have, {i}" for i in range(100_000))
    got = rows_of(dedup(wide((1, text), (2, text + "\nx"), (3, text))))
    assert {i: (r[0], r[2]) for i, r in got.items()} == {1: ("", 100_000), 2: ("x", 100_000), 3: (text, 0)} and time.time() - began < 60


def test_the_shuffled_way_agrees(wide, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    rows = [(i, f"{LONG}\n{i}\n{LONG} {i % 3}") for i in range(30)]
    assert rows_of(dedup(wide(*rows))) == slow(rows)


def python_tasks(monkeypatch, docs):
    """Gets the functions that docs' kind of table gives to mapInArrow."""
    found, original = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: found.append(f) or original(self, f, *a, **b))
    return found


def test_workers_let_the_vocabulary_of_another_stage_go(wide, monkeypatch):
    docs = wide(*[(i, f"{LONG}\nand some more words that only number {i} has") for i in range(4)])
    tasks = python_tasks(monkeypatch, docs)
    toxicity.drop_toxic(docs, toxicity.Model({}, toxicity.np.zeros(0), toxicity.np.array([40.0, 41.0])))
    line_dedup.without_common_lines(docs)
    near_copies.near_copies(docs)
    assert len(tasks) >= 6
    for task in tasks:
        bpe._codec(b"YQ== 0\nYg== 1\n", ".")
        list(task(iter([])))
        gc.collect()
        assert not [x for x in gc.get_objects() if isinstance(x, bpe.Codec)]


def test_texts_go_back_in_small_batches(wide, monkeypatch):
    rows = [(i, f"{LONG}\nline {i}") for i in range(1000)]
    docs = wide(*rows)
    tasks = python_tasks(monkeypatch, docs)
    out = dedup(docs)
    whole = pa.RecordBatch.from_pylist([{"row": {"doc_id": i}, "text": t, "gone": [0] if i < 999 else None} for i, t in rows])
    batches = list(tasks[-1](iter([whole])))
    assert [b.num_rows for b in batches] == [256, 256, 256, 232]
    assert [x for b in batches for x in b.column(2).to_pylist()] == [f"line {i}" for i in range(999)] + [None]
    assert rows_of(out) == slow(rows)
