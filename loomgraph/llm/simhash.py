"""SimHash near-duplicates: multi-index hashing over two 32-bit segments.

Fingerprints within max_bits (4) differ by 2 bits or fewer in one of the two segments. Two segment values that close
have a common neighbour at distance 1 or less, so every fingerprint enters the 33-key Hamming ball of each of its
segments into one table, and fingerprints that meet under a key are the candidates; their complete distance is
verified. Keys hold 32 bits, so chance meetings stay rare however many fingerprints there are.

Under a key each fingerprint is compared with the FULL_KEY before it, which are all pairs of a key of ordinary size, and the
rows need to be dealt out and sorted only once. Under a fuller key (a very large group of near copies) comparing all pairs
would grow with the square of the group. There each fingerprint enters its ball of radius 2 over all 64 bits:
two fingerprints share a key of that kind if and only if they differ by 4 bits or fewer, and a star of links under
each key joins what belongs together. Such a key is shared by 2,081 fingerprints at most. No candidate is dropped.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import scratch
from .components import connected_components

MAX_BITS = 4
#: Keys with more fingerprints than this take the way by balls over all bits, which costs each of them 2,081 keys.
FULL_KEY = 512
SEED = 42
_PIECE = 1 << 17


def fingerprint(text: str | None, words: int = 4, lanes: int = 1) -> list[int]:
    """The 64-bit SimHashes of one text, one for each lane, whose hashes have seeds of their own; zero without words. Works
    through long texts piecewise, in bounded memory."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return [0] * lanes
    n = max(1, len(tokens) - words + 1)
    line = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    end = (end[words - 1 :] if len(tokens) > words else end[-1:]).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros((lanes, 64), dtype=np.int64)
    for i in range(0, n, _PIECE):
        shingles = [line[a:b] for a, b in zip(start[i : i + _PIECE], end[i : i + _PIECE])]
        for k in range(lanes):
            h = np.array([digest(s, SEED + k) for s in shingles], dtype="<u8")
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """(id_col, fps): fps holds each lane's 64 bits as a signed long. One row per input row."""
    schema = StructType([docs.schema[id_col], StructField("fps", ArrayType(LongType(), False))])

    def run(batches):
        for batch in batches:
            flat = np.array([fingerprint(x.as_py(), words, lanes) for x in batch.column(1)], dtype=np.uint64).reshape(-1).view(np.int64)
            ends = pa.array(np.arange(0, len(flat) + 1, lanes, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _balls(prints: DataFrame) -> DataFrame:
    """(fp, key, own): 66 keys for each fingerprint; own is the segment value that the key is near."""
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << i for i in range(32))]])
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).bitwiseOR(F.lit(1 << 32).cast("long"))
    return prints.select("fp", F.explode(F.array(high, low)).alias("own")).select("fp", "own", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("key"))


def _wide_masks() -> list[int]:
    bits = [1 << i for i in range(64)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [0, *map(signed, bits), *(signed(a | b) for a, b in combinations(bits, 2))]


def links(prints: DataFrame, max_bits: int = MAX_BITS, full_key: int = FULL_KEY) -> DataFrame:
    """(src, dst) between distinct fingerprints of column fp: every pair within max_bits is joined by a chain of
    returned links, each of which is such a pair or (in full keys) two such pairs through one fingerprint's key."""
    if max_bits not in (0, 2, 4):
        raise ValueError("max_bits is 0, 2 or 4: two segments with balls of radius 1 reach no further")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _balls(prints.select("fp").repartition(parts, "fp"))
    under = Window.partitionBy("key").orderBy("fp")
    before = F.collect_list(F.struct("fp", "own")).over(under.rowsBetween(-full_key, -1))
    met = rows.withColumn("before", before).withColumn("n", F.row_number().over(under))
    # A pair whose segment values are equal meets under 33 keys; it counts under the value itself.
    near = F.expr(f"transform(filter(before, y -> bit_count(fp ^ y.fp) <= {max_bits} and (own <> y.own or own = key)), y -> y.fp)")
    # Beyond full_key a row stands for itself and those before it: the members of its key.
    full = F.when(F.col("n") > full_key, F.concat(F.array("fp"), F.transform("before", lambda y: y["fp"])))
    found = scratch.cut(met.where("n > 1").select("fp", near.alias("near"), full.alias("full")).where("size(near) > 0 or full is not null"), "met")
    close = found.select(F.col("fp").alias("b"), F.explode("near").alias("a"))
    dense = found.select(F.explode("full").alias("fp")).distinct()
    masks = F.array(*[F.lit(m).cast("long") for m in _wide_masks() if (m & (2**64 - 1)).bit_count() <= max_bits // 2])
    ball = dense.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))
    star = ball.select(F.col("fp").alias("b"), F.min("fp").over(Window.partitionBy("at")).alias("a")).where("a <> b")
    return close.select("a", "b").unionByName(star.select("a", "b")).distinct().select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = MAX_BITS, lanes: int = 1, full_key: int = FULL_KEY) -> DataFrame:
    """(id_col, fingerprint, component_id): the group of every row whose id is not null.

    Texts link if their fingerprints of any lane differ by max_bits or fewer; more lanes find more of the pairs whose
    similarity is near the bound. fingerprint is that of the first lane; component_id is the smallest id that links reach.
    Null and wordless texts have fingerprint zero and link like any other. Exact copies enter the search as one row, so
    their groups may have any size. Repeated ids give one row each. Other columns of docs are ignored.
    """
    prints = scratch.cut(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words, lanes), "prints")
    nodes = scratch.cut(prints.groupBy("fps").agg(F.min(id_col).alias("node")), "nodes")
    edges = []
    for k in range(lanes):
        lane = scratch.cut(nodes.groupBy(F.col("fps")[k].alias("fp")).agg(F.min("node").alias("low")), "lane")
        a, b = lane.select(F.col("fp").alias("src"), F.col("low").alias("u")), lane.select(F.col("fp").alias("dst"), F.col("low").alias("v"))
        edges.append(scratch.cut(links(lane.select("fp"), max_bits, full_key).join(a, "src").join(b, "dst").select("u", "v"), "links"))
        if lanes > 1:  # texts that differ, but not in this lane
            same = nodes.join(lane, F.col("fps")[k] == F.col("fp")).where("node <> low")
            edges.append(same.select(F.col("node").alias("u"), F.col("low").alias("v")))
    found = connected_components(reduce(DataFrame.unionByName, edges), "u", "v").withColumnRenamed("node", "of")
    grouped = nodes.join(found, nodes.node == found.of, "left").select("fps", F.coalesce("component", "node").alias("component_id"))
    return prints.join(grouped, "fps").select(id_col, F.lpad(F.lower(F.hex(F.col("fps")[0])), 16, "0").alias("fingerprint"), "component_id")
