"""Byte-level BPE encoding and decoding.

Merging one piece of a text: a segment tree over the piece's byte positions holds, in each node, the least pair rank
below it and the leftmost position with that rank. The root names the next merge; a merge changes the ranks of two live
neighbours and retires one position, so it costs three logarithmic point updates, and a piece of n bytes O(n log n).
"""

from __future__ import annotations

import base64
from array import array
from itertools import chain, islice
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import worker

_NONE = 1 << 60
#: Pieces up to this many bytes are remembered by a worker, up to this many of them in each of two generations.
_SHORT, _REMEMBERED = 48, 1 << 18
_MANY = 1 << 20


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one piece."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    width = 1 << max(1, (n - 1).bit_length())
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n - 1))  # where the part before this one begins
    get = ranks.get
    # A node is rank * width + position: the least is the lowest rank, and of equal ranks the leftmost.
    tree = [_NONE] * (2 * width)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * width + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                break
            tree[k] = a
            k >>= 1

    def rank_at(i: int) -> int:
        middle = after[i]
        rank = get(piece[i : after[middle]]) if middle < n else None
        return _NONE if rank is None else rank * width + i

    while tree[1] < _NONE:
        i = tree[1] % width
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, _NONE)
        put(i, rank_at(i))
        if before[i] >= 0:
            put(before[i], rank_at(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec(dict):
    """Encodes and decodes; as a dictionary it remembers the ids of short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = tuple(merge_piece(raw, self.ranks))
            if len(raw) > _SHORT:
                return ids
        if len(self) >= _REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> array:
        ids = array("i")
        if not text:
            return ids
        if len(text) <= _MANY:
            ids.extend(chain.from_iterable(map(self.__getitem__, self.pieces.findall(text))))
            return ids
        found = (m.group() for m in self.pieces.finditer(text))
        while some := list(islice(found, 1 << 16)):
            ids.extend(chain.from_iterable(map(self.__getitem__, some)))
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _codec(content: bytes, pattern: str) -> Codec:
    """One for each worker process and vocabulary, until the worker runs something else."""
    return worker.keep(("bpe", len(content), hash(content), pattern), lambda: Codec(read_ranks(content), pattern))


def _shared(df: DataFrame, ranks_path: str):
    """The vocabulary file, broadcast: its size is that of one vocabulary, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """(id_col, ids): the token ids of each whole text, row for row, as the tiktoken library's encode_ordinary gives them.

    Null and empty texts have no ids. Special tokens' strings are ordinary text. Nulls and repeats of ids stay as they
    are; other columns are ignored.
    """
    content = _shared(docs, ranks_path)
    schema = StructType([docs.schema[id_col], StructField("ids", ArrayType(IntegerType(), False))])

    def run(batches):
        codec = _codec(content.value, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                flat, ends = array("i"), [0]
                for text in part.column(1):
                    flat.extend(codec.encode(text.as_py()))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", batch: int = 256) -> DataFrame:
    """(id_col, ids, decoded): the bytes that the ids stand for; null ids count as none. An id that the vocabulary
    lacks raises KeyError."""
    content = _shared(tokens, ranks_path)
    schema = StructType([tokens.schema[id_col], StructField("ids", ArrayType(IntegerType(), False)), StructField("decoded", BinaryType())])

    def run(batches):
        codec = _codec(content.value, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                ids = part.column(1)
                text = [codec.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(text, pa.binary())], names=schema.names)

    return tokens.select(id_col, ids_col).mapInArrow(run, schema)
