"""Near copies by a similarity bound: SimHash with multi-index hashing gives the candidates, shingle sets verify them.

The similarity is Jaccard's, of the sets of five-word shingles. A bit of two SimHashes differs with probability
acos(2s / (1 + s)) / pi, 0.15 at s = 0.8, so 64 bits cannot tell such pairs from others and wide fingerprints are made. They
are cut into segments of `bits` bits. A text's segment is dealt out once, by its upper bits; where it lands it enters the Hamming
ball of radius 1 of its `low` lower bits, so two texts meet if the upper bits of a segment are equal and the lower ones differ by
two or fewer. bits follows the logarithm of the number of texts, which keeps chance meetings few at any size; the number of
segments follows from the recall wanted of pairs at the bound. 256 more bits go with every row: pairs far apart in them are not
candidates.

Texts that are equal after lower-casing and white space are one class, which enters once. Candidate pairs are not written down: each
task gives a spanning forest of those that it meets, and what these connect is a family. Keys of up to FULL_KEY classes compare all
their pairs. In a fuller key the classes not far from the one with the most neighbours are joined to it, and the others, there by
chance mostly, are compared with every class; if these would fill a key themselves, all are joined. A family is cut into blocks, and
each pair of blocks is work of its own that compares all its texts by their sets and gives back a spanning forest of the links. No
pair that meets under a key is left out.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import scratch, worker
from .components import connected_components, forest

RECALL, FULL_KEY, CARRIED, SEED = 0.995, 48, 4, 42
#: Texts that a key holds by chance, at most on average: a family does not come of such keys.
BY_CHANCE = 5
#: A family's block holds so many texts, and so many shingles, or one text.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22
#: Bytes of (class, id) rows that may be broadcast to pick the texts that have to be compared: 48 for each.
BROADCAST_BYTES = 16 << 20
_PIECE, _OFTEN = 255, 1 << 14
#: Links that a task holds before it keeps a forest of them only.
_HELD = 1 << 18


def differ(least: float) -> float:
    """The probability that a bit of the SimHashes differs, of two texts of this similarity."""
    return math.acos(2 * least / (1 + least)) / math.pi


def plan(rows: int, least: float, recall: float = RECALL) -> tuple[int, int, int]:
    """(bits in a segment, lower bits of these that may differ, segments)."""
    p, bits = differ(least), 15
    lower = lambda bits: bits - bits * 9 // 20
    while rows * (lower(bits) + 1) > BY_CHANCE << bits and bits < 32:
        bits += 1
    low = lower(bits)
    meet = (1 - p) ** (bits - low) * sum(math.comb(low, k) * p**k * (1 - p) ** (low - k) for k in range(3))
    return bits, low, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def reach(width: int, least: float, deviations: float = 3.0) -> int:
    """The largest distance in `width` bits that pairs at the bound have, all but one or two in a thousand."""
    p = differ(least)
    return min(width, math.ceil(width * p + deviations * math.sqrt(width * p * (1 - p))))


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # as simhash.fingerprint()


def _class(tokens: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(tokens))


_PLACE = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(tokens: list[bytes], words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles, each from the hashes of its words by their places; fewer words than that are one
    shingle."""
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens, repeat(SEED)), dtype=np.uint64, count=len(tokens))
    words = min(words, len(h))
    n = len(h) - words + 1
    out = np.full(n, words, dtype=np.uint64)
    for k in range(words):
        out += h[k : k + n] * _PLACE[k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    out = np.sort(out ^ (out >> np.uint64(32)))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


#: The eight bits of a byte, each in a byte of a long: sums of up to 255 of them do not overflow.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """lanes longs of 64 bits: the SimHash of a set of hashes. Every lane mixes the hashes anew."""
    ones = np.zeros(lanes * 64, dtype=np.int64)
    step = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, lanes + 1, dtype=np.uint64)
    for i in range(0, len(hashes), _PIECE):
        x = hashes[i : i + _PIECE, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += _SPREAD[x.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def segments(prints: np.ndarray, bits: int, count: int) -> np.ndarray:
    """(rows, count) keys: the segment's number above its value."""
    flat = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, : bits * count].reshape(len(prints), count, bits)
    return (flat * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2) + (np.arange(count, dtype=np.int64) << 32)


def _signed(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int, count: int) -> DataFrame:
    """(id_col, class, parts, lanes) of every row that has words; the last CARRIED lanes are not cut into segments."""
    lanes = -(-bits * count // 64) + CARRIED
    schema = StructType([docs.schema[id_col], StructField("class", BinaryType()), StructField("parts", ArrayType(LongType(), False)), StructField("lanes", ArrayType(LongType(), False))])

    def rows_of(table: np.ndarray) -> pa.Array:
        flat = np.ascontiguousarray(table).reshape(-1).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), pa.array(flat))

    def run(batches):
        worker.release()
        for batch in batches:
            at, classes, found = [], [], []
            for i, x in enumerate(batch.column(1)):
                if tokens := _tokens(x.as_py()):
                    at.append(i)
                    classes.append(_class(tokens))
                    found.append(wide_fingerprint(shingles(tokens, words), lanes))
            prints = np.array(found, dtype=np.uint64).reshape(len(found), lanes)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(classes, pa.binary()), rows_of(segments(prints, bits, count)), rows_of(prints)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b): each node but the least of its tree, with that."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(len(ids), at[: len(a)], at[len(a) :])
    some = np.nonzero(root != np.arange(len(ids)))[0]
    return ids[some], ids[root[some]]


def _forests(rows: DataFrame) -> DataFrame:
    """(u, v): of the links of (node, near, hub) rows, to each of near and to a hub that is not null, a spanning forest of each task."""

    def run(batches):
        worker.release()
        none = np.zeros(0, dtype=np.int64)
        kept, held = (none, none), []
        for batch in batches:
            node, near, hub = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            some = hub.is_valid().to_numpy(zero_copy_only=False)
            held += [(np.repeat(node, near.value_lengths().to_numpy()), near.flatten().to_numpy()), (node[some], hub.drop_null().to_numpy())]
            if sum(len(x) for x, _ in held) > max(_HELD, len(kept[0])):
                kept, held = spanning(*map(np.concatenate, zip(kept, *held))), []
        kept = spanning(*map(np.concatenate, zip(kept, *held)))
        for i in range(0, len(kept[0]), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 10_000], pa.int64()) for x in kept], names=["u", "v"])

    return rows.select("node", "near", "hub").mapInArrow(run, "u long, v long")


def _meetings(nodes: DataFrame, bits: int, low: int, least: float, full_key: int) -> DataFrame:
    """(u, v): links that connect every two classes that meet under a key and lie near enough."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width, most = 64 * CARRIED, reach(64 * CARRIED, least)
    prints = [f"f{k}" for k in range(CARRIED)]
    apart = lambda y: " + ".join(f"bit_count({c} ^ {y}.{c})" for c in prints)
    near = lambda others: F.expr(f"transform(filter({others}, y -> y.node <> node and {apart('y')} <= {most}), y -> y.node)")
    each = nodes.select("node", *[F.element_at("lanes", -1 - k).alias(c) for k, c in enumerate(prints)], F.explode("parts").alias("part"))
    dealt = each.select("node", *prints, F.shiftright("part", low).alias("top"), F.col("part").bitwiseAND((1 << low) - 1).cast("int").alias("rest")).repartition(parts, "top")
    masks = F.array(*[F.lit(m) for m in [0, *(1 << i for i in range(low))]])
    rows = dealt.select("node", *prints, "top", F.explode(F.transform(masks, lambda m: F.col("rest").bitwiseXOR(m))).alias("key"))
    key, me, full = Window.partitionBy("top", "key"), F.struct("node", *prints), F.col("m") > full_key
    met = rows.withColumn("before", F.collect_list(me).over(key.orderBy("f0", "node").rowsBetween(-full_key, -1))).select("node", *prints, "top", "key", near("before").alias("near"))
    hub = F.max(F.struct(F.size("near").alias("of"), "node", *prints)).over(key)
    met = met.withColumn("m", F.count("*").over(key)).withColumn("hub", hub).where((F.size("near") > 0) | full)
    # In a full key, those far from its hub (there by chance, mostly) are compared with every class.
    met = met.withColumn("far", full & (F.expr(apart("hub")) > (most + width // 2) // 2)).withColumn("n_far", F.count_if("far").over(key))
    stranger = F.col("far") & (F.col("n_far") <= full_key)
    met = met.withColumn("strangers", F.collect_list(F.when(stranger, me)).over(key))
    found = met.select("node", F.when(full, near("strangers")).otherwise(F.col("near")).alias("near"), F.when(full & ~stranger, F.col("hub.node")).alias("hub"))
    # Once more over fewer tasks: what many keys connect is then connected by few links.
    links = scratch.cut(_forests(found.where("size(near) > 0 or hub <> node")).distinct(), "met")
    again = links.repartition(1 + links.count() // _HELD).select(F.col("u").alias("node"), F.array("v").alias("near"), F.lit(None).cast("long").alias("hub"))
    return scratch.cut(_forests(again), "met")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(node, hashes) of the wanted (node, class, low) classes, from rows whose id is low."""

    def run(batches):
        worker.release()
        for batch in batches:
            nodes, sets = [], []
            for node, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = _tokens(text)
                if _class(tokens) == key:  # ids may repeat
                    nodes.append(node)
                    sets.append(shingles(tokens, words).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    small = F.broadcast(wanted) if wanted.count() * 48 <= BROADCAST_BYTES else wanted
    return docs.join(small, docs[id_col] == small["low"]).select("node", "class", text_col).mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) numbers of hashes that two sets of distinct hashes share."""
    sizes = [len(x) for x in left] + [len(x) for x in right]
    word, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    of = np.repeat(np.arange(len(sizes)), sizes)
    mine = of < len(left)
    both = (np.bincount(at[mine], minlength=len(word)) > 0) & (np.bincount(at[~mine], minlength=len(word)) > 0)
    place = np.cumsum(both) - 1
    kept = both[at]
    of, at = of[kept], place[at[kept]]
    out = np.zeros(len(left) * len(right), dtype=np.float32)
    n, is_left = int(both.sum()), of < len(left)
    often = np.bincount(at[is_left], minlength=n) * np.bincount(at[~is_left], minlength=n) > _OFTEN
    # Hashes that many texts have, by matrix products.
    column = np.cumsum(often) - 1
    some = often[at]
    order = np.argsort(column[at[some]], kind="stable")
    row, col = of[some][order], column[at[some]][order]
    for a in range(0, int(often.sum()), 2048):
        lo, hi = np.searchsorted(col, [a, a + 2048])
        held = np.zeros((len(sizes), 2048), dtype=np.float32)
        held[row[lo:hi], col[lo:hi] - a] = 1
        out += (held[: len(left)] @ held[len(left) :].T).reshape(-1)
    # The others, pair by pair.
    mine, theirs = is_left & ~some, ~is_left & ~some
    order = np.argsort(at[theirs], kind="stable")
    words, right_of = at[theirs][order], of[theirs][order] - len(left)
    begin, end = np.searchsorted(words, at[mine], "left"), np.searchsorted(words, at[mine], "right")
    left_of, many = of[mine], end - begin
    upto = np.cumsum(many)
    a = 0
    while a < len(many):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + (1 << 22), "right")))
        k = many[a:b]
        spot = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[a:b], k)
        pair, times = np.unique(np.repeat(left_of[a:b], k) * len(right) + right_of[spot], return_counts=True)
        out[pair] += times
        a = b
    return out.reshape(len(left), len(right))


def _families(met: DataFrame, nodes: DataFrame, docs: DataFrame, least: float, id_col: str, text_col: str, words: int) -> DataFrame:
    """(u, v): verified links between the classes that met connects: of each pair of blocks of a family a spanning forest."""
    families = scratch.cut(connected_components(met, "u", "v"), "families")
    wanted = scratch.cut(nodes.select("node", "class", "low").join(families.select("node"), "node"), "wanted")
    sets = scratch.cut(_sets(docs, wanted, id_col, text_col, words).join(families, "node"), "sets")
    size = sets.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("hashes")) / BLOCK_SHINGLES)).alias("blocks"))
    dealt = sets.join(size, "component").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("component", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "mine", "node", "hashes")

    def compare(batch: pa.Table) -> pa.Table:
        worker.release()
        node, mine = batch["node"].to_numpy(), batch["mine"].to_numpy()
        sets_ = [x.values.to_numpy().view(np.uint64) for x in batch["hashes"]]
        b1, b2 = batch["b1"][0].as_py(), batch["b2"][0].as_py()
        left, right = np.nonzero(mine == b1)[0], np.nonzero(mine == b2)[0]
        out = np.zeros((2, 0), dtype=np.int64)
        if len(left) and len(right):
            size_ = np.array([len(x) for x in sets_])
            both = common([sets_[i] for i in left], [sets_[i] for i in right])
            i, j = np.nonzero(both >= least * (size_[left][:, None] + size_[right][None, :] - both) - 1e-6)
            i, j = left[i], right[j]
            root = forest(len(node), i[i != j], j[i != j])
            some = np.nonzero(root != np.arange(len(node)))[0]
            out = np.array([node[some], node[root[some]]])
        return pa.table({"u": pa.array(out[0]), "v": pa.array(out[1])})

    return scratch.cut(spread.groupBy("component", "b1", "b2").applyInArrow(compare, "u long, v long"), "links")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, words: int = 5, recall: float = RECALL, full_key: int = FULL_KEY) -> DataFrame:
    """(id_col, component_id): the group of every row whose id is not null and whose text has words.

    Texts link if their similarity is least or more; pairs at the bound become candidates with probability recall, closer
    ones more surely, equal texts always. component_id is the smallest id that links reach.
    Null and wordless texts are in no group. Repeated ids give one row each. Other columns of docs are ignored.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    bits, low, count = plan(docs.count(), least, recall)
    signed = scratch.cut(_signed(docs, id_col, text_col, words, bits, count), "signed")
    classes = scratch.cut(signed.groupBy("class").agg(F.min(id_col).alias("low"), F.first("parts").alias("parts"), F.first("lanes").alias("lanes")), "classes")
    nodes = scratch.cut(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    scratch.drop(classes)
    links = _families(_meetings(nodes, bits, low, least, full_key), nodes, docs, least, id_col, text_col, words)
    found = scratch.cut(connected_components(links, "u", "v"), "found")
    lows = found.join(nodes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least_id"))
    of = found.join(lows, "component").select("node", "least_id")
    known = nodes.select("node", "class", "low").join(of, "node", "left").select("class", F.coalesce("least_id", "low").alias("component_id"))
    return signed.join(known, "class").select(id_col, "component_id")
