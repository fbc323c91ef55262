import random
import re

import pytest
from loomgraph.llm import decontaminate
from pyspark.sql import functions as F

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def slow(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for j, s in items:
            v = words(s)
            for win in {tuple(v[k : k + 8]) for k in range(max(1, len(v) - 7))} if v else ():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        found.add(j)
        out[i] = (len(w), len(hit), sorted(found))
    return out


def run(docs, items):
    got = decontaminate.contamination(docs, items).select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), "items")
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()}


def item_frame(frame, items):
    return frame("item_id long, text string, h string, size int, window int", *[(i, t, "x", 1, 2) for i, t in items])


@pytest.mark.parametrize("rows", [500_000, 0])
def test_equals_brute_force(wide, frame, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rng = random.Random(3)
    vocabulary = ["the", "of", "É", "x", "Y", "1x"] + [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 14])))) for i in range(10, 30)] + [(1, None), (2, "..."), (3, "THE the The the"), (4, "a a a a a a a a a a")]
    docs = [(0, None), (1, ""), (2, "--"), (3, "a " * 30), (4, "the-the.THE the")]
    for i in range(5, 60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            text += words(rng.choice(items)[1]) + [rng.choice(vocabulary)] + words(rng.choice(items)[1])
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    assert run(wide(*docs), item_frame(frame, items)) == slow(docs, items)


def test_empty_tables_nulls_and_repeats(wide, frame):
    items = item_frame(frame, [(1, "one two three"), (1, "one two three"), (None, "four")])
    assert run(wide(), items) == {}
    assert run(wide((1, "one two three")), item_frame(frame, [])) == {1: (3, 0, [])}
    assert run(wide((1, "One two three four"), (1, "One two three four"), (None, "one")), items) == {1: (4, 3, [1])}


def test_decontaminate_keeps_clean_rows(wide, frame):
    items = item_frame(frame, [(1, "one two three"), (2, "four five six")])
    docs = wide((1, "one two three"), (2, "one two three, four five six"), (3, None))
    left = decontaminate.decontaminate(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3] and left.columns == docs.columns


def test_ascii_lower(frame):
    df = frame("t string", ("AbÉ",), ("ABC",), (None,), ("İK",))
    assert [r[0] for r in df.select(decontaminate.ascii_lower(F.col("t"))).collect()] == ["abÉ", "abc", None, "İk"]


def test_main_path_has_no_python(wide, frame):
    plan = decontaminate.contamination(wide((1, "a")), item_frame(frame, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
