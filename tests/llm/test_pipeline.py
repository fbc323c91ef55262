import random

import corpus_pipeline
import numpy as np
import pytest
from loomgraph.llm import near_copies

ITEM = "Which of these rivers is the longest one that flows into the northern sea today"


@pytest.fixture
def folder(frame, tmp_path):
    """folder(table=frame, ...): an input folder with these tables."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_passage_of_one_benchmark_item_is_dropped(spark, wide, frame, folder):
    place = folder(benchmark=frame("item_id long, text string", (1, ITEM), (2, "an item that no document of these holds in any place at all")))
    part = " ".join(ITEM.split()[3:11])
    docs = wide((1, f"Before it. {ITEM}? And after it."), (2, f"x {part.upper()} y"), (3, " ".join(ITEM.split()[:7]) + " end"), (4, None), (5, "clean"))
    left = corpus_pipeline.without_benchmark(spark, docs, place)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5] and left.columns == docs.columns


def shingles(text):
    tokens = (text or "").lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))} if tokens else set()


def copies(rows, least=0.8):
    """Ids of rows whose group, by all pairs, has a smaller id."""
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}
    while True:
        near = {i: [j for j in sets if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9] for i in sets}
        new = {i: min([low[i], *(low[j] for j in near[i])]) for i in sets}
        if new == low:
            return {i for i in low if low[i] != i}
        low = new


def changed(rng, words, edits):
    """words with so many of them replaced, evenly spread."""
    out = list(words)
    for k in range(edits):
        out[(2 * k + 1) * len(out) // (2 * edits)] = f"new{rng.random()}"
    return out


def test_near_copies_at_the_bound_are_found(spark, wide):
    rng = random.Random(7)
    rows = []
    for k in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(150, 400))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, "\n".join(changed(rng, base, int(len(base) * 0.1 / 5))).upper())]
    alike = [len(a & b) / len(a | b) for a, b in ((shingles(rows[i][1]), shingles(rows[i + 1][1])) for i in range(0, 80, 2))]
    assert 0.8 <= min(alike) and max(alike) < 0.87
    left = corpus_pipeline.without_near_copies(spark, wide(*rows), "")
    assert {r.doc_id for r in left.collect()} == {2 * k for k in range(40)} and left.columns == wide().columns


def test_large_group_is_joined(spark, wide):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, base, rng.randint(0, 2)))) for i in range(150)] + [(1000, "Short One"), (1001, "short  one"), (1000, "another text of the same id")]
    for full_key in (8, 512):
        got = {(r.doc_id, r.component_id) for r in near_copies.near_copies(wide(*rows), full_key=full_key).collect()}
        assert got == {(i, 0) for i in range(150)} | {(1000, 1000), (1001, 1000)}


def test_full_keys_lose_no_pair(spark, wide):
    """A family of texts about 0.7 alike, which meet under the same keys without being linked; inside it lie pairs that are."""
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(60)], []
    for k in range(60):
        one = changed(rng, base, 2)
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join([*one[:-1], "end"]))]
    want = copies(rows)
    got = [{r.doc_id for r in near_copies.near_copies(wide(*rows), full_key=k).where("doc_id <> component_id").collect()} for k in (3, 512)]
    assert got[0] == want and got[1] <= want and len(got[1]) >= 0.95 * len(want)


def test_families_are_compared_block_by_block(spark, wide, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(80)], []
    for k in range(50):
        rows.append((k, " ".join(changed(rng, base, rng.randint(0, 5)))))
    got = {r.doc_id for r in near_copies.near_copies(wide(*rows), full_key=3).where("doc_id <> component_id").collect()}
    assert got == copies(rows)
    sets = [np.unique(np.array([rng.randrange(9000) for _ in range(rng.randrange(1, 6000))], dtype=np.uint64)) for _ in range(9)]
    for often in (0, 3, 10**9):
        monkeypatch.setattr(near_copies, "_OFTEN", often)
        assert (near_copies.common(sets[:4], sets[4:]) == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]).all()


def test_each_segment_is_dealt_out_once(wide, monkeypatch):
    """Rows that cross the network grow with the segments, not with the balls around them."""
    made, cut = {}, near_copies.scratch.cut
    monkeypatch.setattr(near_copies.scratch, "cut", lambda df, label: made.setdefault(label, df) and cut(df, label))
    near_copies.near_copies(wide((1, "a b c d e f"), (2, "a b c d e f g"))).collect()
    plan = made["met"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(transform(") < plan.index("RepartitionByExpression [top") < plan.index("Generate explode(parts")


def test_links_of_a_family_grow_with_its_texts(spark, wide, monkeypatch):
    """A clique of near copies, whose pairs are many more: neither what meets nor what is linked lists them."""
    made, cut = {}, near_copies.scratch.cut
    monkeypatch.setattr(near_copies.scratch, "cut", lambda df, label: made.setdefault(label, []).append(cut(df, label)) or made[label][-1])
    rng = random.Random(13)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(changed(rng, base, 1 + i % 2))) for i in range(120)]
    assert {r.component_id for r in near_copies.near_copies(wide(*rows), full_key=200).collect()} == {0}
    assert made["links"][0].count() < 2 * len(rows) and made["met"][-1].count() < 2 * len(rows)


def test_strangers_under_a_full_key_are_no_family(spark, wide, monkeypatch):
    """Classes that are under a full key by chance are compared with its members, not joined to them."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(changed(rng, base, 1))) for i in range(40)] + [(100 + i, " ".join(f"x{rng.random()}" for _ in range(150))) for i in range(6)]
    nodes = [(i, near_copies.wide_fingerprint(near_copies.shingles(near_copies._tokens(t)), 4).view(np.int64).tolist()) for i, t in rows]
    met = near_copies._meetings(spark.createDataFrame([(i, [5], f) for i, f in nodes], "node long, parts array<long>, lanes array<long>"), 15, 9, 0.8, 20)
    found = {x for r in met.collect() for x in r}
    assert found == set(range(40))


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 700):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        got = near_copies.wide_fingerprint(hashes, 3)
        one = np.array([near_copies.wide_fingerprint(hashes[i : i + 1], 3) for i in range(n)])  # of a single hash: the mixed hash itself
        bits = np.unpackbits(one.view(np.uint8), axis=1, bitorder="little").sum(axis=0)
        assert (np.unpackbits(got.view(np.uint8), bitorder="little") == (bits * 2 > n)).all()
    parts = near_copies.segments(rng.integers(0, 1 << 63, (4, 3), dtype=np.uint64), 20, 7)
    assert parts.shape == (4, 7) and (parts >> 32 == np.arange(7)).all() and (parts & 0xFFFFFFFF < 1 << 20).all()


def test_only_verified_copies_are_dropped(spark, wide):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(3000)}" for _ in range(300)] for _ in range(12)]
    rows = [(100 * k + n, " ".join(changed(rng, b, n))) for k, b in enumerate(base) for n in range(0, 16)]
    want = copies(rows)
    assert len(want) < len(rows) - len(base)
    odd = [(5000, None), (5001, None), (5002, ""), (5003, " \n"), (5004, "word"), (5005, "Word")]
    left = corpus_pipeline.without_near_copies(spark, wide(*rows, *odd), "")
    assert {i for i, _ in rows + odd} - {r.doc_id for r in left.collect()} == want | {5005}
