"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

A line's key is the line without the ASCII white space at its ends, A-Z lower-cased; its hash has 128 bits. A document
offers each hash once, so counting documents is a plain sum with map-side combining, whatever line is common. Only
lines of hashes over the threshold take part in the join that finds positions, and documents get back an array of
positions to leave out. The table of common hashes is broadcast only below a checked size; beyond it the join is
shuffled, where adaptive execution splits the hot hashes. A document is put together again in one pass over its lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from . import scratch, worker

_SPACE = b" \t\n\v\f\r"
#: Bytes that the table of common hashes may take to be broadcast: 64 for each row in a hash table.
BROADCAST_BYTES = 64 << 20
#: Rows whose texts are put together at once, and go back in one batch: both sides hold such a batch in memory.
BATCH = 256


def line_key(line: bytes) -> bytes:
    """bytes.lower() changes A-Z only, as asked."""
    return line.strip(_SPACE).lower()


def _keyed(text: str | None, least_chars: int):
    """(position, hash) of the lines long enough to count."""
    for at, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        key = line_key(line)
        if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least_chars):
            yield at, xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> list[pa.Array]:
    """The 128-bit digests as two columns of 64 bits."""
    both = np.frombuffer(b"".join(digests), dtype=np.int64)
    return [pa.array(np.ascontiguousarray(both[k::2])) for k in (0, 1)]


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20) -> DataFrame:
    """(id_col, at, h1, h2): a row for each line whose key has least_chars code points or more."""
    schema = StructType([docs.schema[id_col], StructField("at", IntegerType()), StructField("h1", LongType()), StructField("h2", LongType())])

    def run(batches):
        worker.release()
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            row, at, digest = [], [], []

            def full():
                return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), *_halves(digest)], names=schema.names)

            for i in range(len(ids)):
                for a, h in _keyed(text[i].as_py(), least_chars):
                    row.append(i)
                    at.append(a)
                    digest.append(h)
                    if len(row) >= 50_000:
                        yield full()
                        row, at, digest = [], [], []
            if row:
                yield full()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def common_lines(hashes: DataFrame, id_col: str = "doc_id", least_docs: int = 3) -> DataFrame:
    """(h1, h2, n_docs, last_id) of the hashes that least_docs distinct ids or more hold. hashes has no null id."""
    once = hashes.groupBy("h1", "h2").agg(F.min(id_col).alias("first"), F.max(id_col).alias("last_id"), F.count("*").alias("n"))
    maybe = scratch.cut(once.where((F.col("n") >= least_docs) & (F.col("first") < F.col("last_id"))).select("h1", "h2"), "maybe")
    some = hashes.join(_small(maybe), ["h1", "h2"], "left_semi")
    # Dealt by document too, so that a hash which a third of all documents hold is spread before it is counted.
    by_doc = some.repartition("h1", "h2", id_col).groupBy("h1", "h2", id_col).agg(F.count("*").alias("n"))
    return by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max(id_col).alias("last_id")).where(F.col("n_docs") >= least_docs)


def _small(table: DataFrame) -> DataFrame:
    """table, to be broadcast if its counted rows fit the bound."""
    return F.broadcast(table) if table.count() * 64 <= BROADCAST_BYTES else table


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(id_col, gone): for each document that loses lines, the positions of these lines."""
    hashes = scratch.cut(line_hashes(docs.where(F.col(id_col).isNotNull()), id_col, text_col, least_chars), "lines")
    common = scratch.cut(common_lines(hashes, id_col, least_docs), "common")
    lost = hashes.join(_small(common.select("h1", "h2", "last_id")), ["h1", "h2"]).where(F.col(id_col) != F.col("last_id"))
    return lost.groupBy(id_col).agg(F.collect_set("at").alias("gone"))


def _reassembled(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_docs: int) -> DataFrame:
    """(row, text, kept, n_lines, n_dropped): row is a struct of the other columns, so that no name can clash. kept is null where
    nothing is dropped."""
    gone = dropped_positions(docs, id_col, text_col, least_chars, least_docs).select(F.col(id_col).alias("of"), "gone")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    joined = rows.join(gone, F.col("id") == F.col("of"), "left").select("row", "text", "gone")
    schema = StructType([joined.schema["row"], *(StructField(n, k) for n, k in (("text", StringType()), ("kept", StringType()), ("n_lines", LongType()), ("n_dropped", LongType())))])

    def run(batches):
        worker.release()
        for batch in (whole.slice(lo, BATCH) for whole in batches for lo in range(0, whole.num_rows, BATCH)):
            kept, lines, dropped = [], [], []
            for text, positions in zip(batch.column(1), batch.column(2)):
                if not positions.is_valid:
                    kept.append(None)
                    lines.append(text.as_buffer().to_pybytes().count(b"\n") + 1 if text.is_valid else 1)
                    dropped.append(0)
                    continue
                out, all_lines = set(positions.as_py()), (text.as_py() or "").split("\n")
                stay = [line for i, line in enumerate(all_lines) if i not in out]
                kept.append("\n".join(stay) if len(stay) < len(all_lines) else None)
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def _back(docs: DataFrame, text_col: str, text) -> list:
    """The columns of docs in their order, from a reassembled table."""
    return [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
    """docs with three more columns: the lines that stay, joined by line feeds, and the numbers of lines and of dropped ones.

    A line whose key has least_chars code points or more and is found in least_docs distinct documents or more stays
    only in the document with the largest id that holds it (there with all its repeats); shorter and rarer lines stay
    everywhere. Null and empty texts are one empty line and come back as an empty text. Rows with a null id keep their
    lines and are not counted. Rows that repeat an id count as one document; each of them loses the lines that any of them
    loses by position. Other columns pass through whatever their names; one named like one of `names` is an error.
    """
    if set(names) & set(docs.columns):
        raise ValueError(f"docs already has a column of {names}; give other names")
    made = _reassembled(docs, id_col, text_col, least_chars, least_docs)
    new = (F.coalesce("kept", "text", F.lit("")), F.col("n_lines"), F.col("n_dropped"))
    return made.select(*_back(docs, text_col, F.col("text")), *[c.alias(n) for c, n in zip(new, names)])


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None, **how) -> DataFrame:
    """docs with the texts that dedup_lines() keeps; chars_col, if given, becomes the length of a text that changed. Texts that lose
    nothing, nulls among them, and all other columns stay as they are."""
    made = _reassembled(docs, id_col, text_col, **({"least_chars": 20, "least_docs": 3} | how))
    out = made.select(*_back(docs, text_col, F.coalesce("kept", "text")), F.col("kept").alias("_k" + "_" * max(map(len, docs.columns))))
    kept = out.columns[-1]
    if chars_col:
        out = out.withColumn(chars_col, F.when(F.col(kept).isNotNull(), F.length(kept)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return out.drop(kept)
