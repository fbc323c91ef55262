import random

import xxhash
from loomgraph.llm import simhash
from loomgraph.llm.components import connected_components


def slow(text, words=4, seed=42):
    tokens = []
    word = b""
    for byte in (text or "").encode() + b" ":
        c = bytes([byte + 32 if 65 <= byte <= 90 else byte])
        if c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"):
            if word:
                tokens.append(word)
            word = b""
        else:
            word += c
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hs = [xxhash.xxh64_intdigest(s, seed=seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, bits=4):
    """Smallest id reachable, by all pairs."""
    low = {i: i for i in fps}
    while True:
        new = {i: min(low[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= bits) for i in fps}
        if new == low:
            return low
        low = new


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "\u00a0x", "Ab"]
    texts = [None, "", " \t\n", "One", "one", "a b c", "a b c d e"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    return list(enumerate(texts))


def test_fingerprints():
    for _, t in corpus():
        assert simhash.fingerprint(t) == [slow(t)]
        assert simhash.fingerprint(t, 5, 3) == [slow(t, 5, 42 + k) for k in range(3)]


def test_long_text_works_through_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 100)
    assert simhash.fingerprint(text) == whole == [slow(text)]


def test_groups_equal_all_pairs(spark, wide):
    rows = [(i * 3 - 7, t) for i, t in corpus()]
    want = groups({i: slow(t) for i, t in rows})
    for full in (512, 2):
        got = simhash.near_duplicates(wide(*rows, (None, "gone")), full_key=full).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert {r.doc_id: r.fingerprint for r in got} == {i: f"{slow(t):016x}" for i, t in rows}


def test_lanes_link_texts_near_in_any_of_them(spark, wide):
    rows = [(i, t) for i, t in corpus(8)]
    prints = {i: [slow(t, 5, 42 + k) for k in range(3)] for i, t in rows}
    low = {i: i for i, _ in rows}
    while True:
        new = {i: min(low[j] for j in low if any((a ^ b).bit_count() <= 4 for a, b in zip(prints[i], prints[j]))) for i in low}
        if new == low:
            break
        low = new
    got = simhash.near_duplicates(wide(*rows), words=5, lanes=3).collect()
    assert {r.doc_id: r.component_id for r in got} == low
    assert len(set(low.values())) < len(set(groups({i: p[0] for i, p in prints.items()}).values()))


def test_dense_group_takes_the_way_by_balls(spark, frame):
    rng = random.Random(1)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 150:
        x = base
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = groups({signed(x): x for x in fps})
    for full in (512, 10):
        found = {r.node: r.component for r in connected_components(simhash.links(frame("fp long", *[(signed(x),) for x in fps]), 4, full)).collect()}
        assert {x: found.get(x, x) for x in want} == want


def test_repeated_rows_and_empty_table(spark, wide):
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(wide((2, "a b"), (2, "a b"), (1, "A  b"))).collect()) == [(1, 1), (2, 1), (2, 1)]
    assert simhash.near_duplicates(wide()).count() == 0


def test_components(frame):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (100, 98), (7, 7), (None, 3), (1, 2)]
    got = {r.node: r.component for r in connected_components(frame("src long, dst long", *chain)).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {98: 98, 99: 98, 100: 98}
    assert connected_components(frame("src long, dst long")).count() == 0
