"""WARC archives, content-addressed.

write_warc() turns pages into WARC/1.1 records and lets Spark's own text writer put them down: a record ends in two
line breaks, which is the writer's line separator. read_warc() reads archives back by their Content-Length fields, record by
record: a worker holds no more of an archive than the record that it is at, however large the file.
store() keeps each distinct payload once, under its SHA-256 and length, in a table bucketed by these, and the exact header bytes of
every record in another; reconstruct() joins the two, where the payloads stay in their buckets, and verifies each payload's
digest again.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from . import scratch

_END = "\r\n\r\n"
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1000
#: Repeated payloads' keys are broadcast up to this many (about 100 bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = StructType([StructField("header", BinaryType()), StructField("record_id", StringType()), StructField("record_type", StringType()), StructField("target_uri", StringType()), StructField("refers_to", StringType()), StructField("stated_digest", StringType()), StructField("block", BinaryType())])


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def pages_to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """(record): the text of a WARC record for each page.

    A null html is an empty payload; a null url gives no WARC-Target-URI. Of pages whose payloads of least_revisit
    bytes or more are equal, that with the largest id holds the payload (any one of them where it repeats, nulls last); the others
    are revisit records that refer to it. A record is named <urn:page:ID>; rows that share an id, and those without, are named
    <urn:page:ID#N>, N being a number of the row's own. Line breaks in urls are percent-encoded. Other columns are ignored.
    """
    some = pages.select(F.col(id_col).alias("_order"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("body"))
    shared = scratch.cut(some.groupBy("_order").agg(F.count("*").alias("_n")).where("_n > 1 or _order is null").select("_order"), "shared")
    own = some.withColumn("_row", F.lit(-1).cast("long"))
    if not shared.isEmpty():
        small = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
        same = some["_order"].eqNullSafe(small["_order"])
        several = scratch.cut(some.join(small, same, "left_semi"), "several").withColumn("_row", F.monotonically_increasing_id())
        own = some.join(small, same, "left_anti").withColumn("_row", F.lit(-1).cast("long")).unionByName(several)
    name = F.concat(F.coalesce(F.col("_order").cast("string"), F.lit("")), F.when(F.col("_row") >= 0, F.concat(F.lit("#"), F.col("_row").cast("string"))).otherwise(F.lit("")))
    rows = own.select("*", name.alias("id"), F.octet_length("body").alias("size"), F.sha1(F.col("body").cast("binary")).alias("sha1"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"))
    repeated = rows.where(F.col("size") >= least_revisit).groupBy("sha256", "size").agg(F.max(F.struct("_order", "_row", "id")).alias("_last"), F.count("*").alias("_of")).where("_of > 1").select("sha256", "size", F.col("_last.id").alias("_last"))
    last = scratch.cut(repeated, "repeated")
    joined = rows.join(F.broadcast(last) if last.count() <= BROADCAST_ROWS else last, ["sha256", "size"], "left")
    revisit = F.col("_last").isNotNull() & (F.col("_last") != F.col("id"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id"), F.lit(">"))),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", url)).otherwise(F.lit("")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_last"), F.lit(">"))))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(_END),
    )
    return joined.select(F.concat(header, block).alias("record"))


def write_warc(records: DataFrame, path: str, rows_per_file: int = 4000) -> None:
    """Writes records as gzip-compressed WARC files of at most rows_per_file records each."""
    records.select("record").write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def _field(header: bytes, name: bytes) -> str | None:
    found = re.search(rb"\r\n" + name + rb":[ \t]*([^\r\n]*)", header, re.I)
    return found[1].decode("utf-8", "replace").strip() if found else None


def parse_records(data: bytes):
    """(header, block) of each record, as exact bytes. Plain and gzip-compressed archives; a cut-off one is an error."""
    while data[:2] == b"\x1f\x8b":  # one member for the file, or one for each record
        parts = []
        while data:
            unpack = zlib.decompressobj(31)
            parts.append(unpack.decompress(data) + unpack.flush())
            if not unpack.eof:
                raise ValueError("a gzip member is cut off")
            data = unpack.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        size = _LENGTH.search(data, at, end + 2) if end >= 0 else None
        if not data.startswith(b"WARC/", at) or size is None:
            raise ValueError(f"no record header at byte {at}")
        end += 4
        last = end + int(size[1])
        if data[last : last + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield data[at:end], data[end:last]
        at = last + 4


class _Cutter:
    """Cuts a stream of bytes into records; holds what is not cut yet."""

    def __init__(self):
        self.rest, self.need = bytearray(), 0

    def feed(self, piece: bytes):
        """(header, block) of the records that piece completes."""
        self.rest += piece
        while len(self.rest) >= max(self.need, 1):
            end = self.rest.find(b"\r\n\r\n")
            if end < 0 or self.rest[:1] in b"\r\n" and not self.rest.strip(b"\r\n"):
                return
            size = _LENGTH.search(self.rest, 0, end + 2)
            if not self.rest.startswith(b"WARC/") or size is None:
                raise ValueError("no record header where a record should begin")
            end += 4
            last = end + int(size[1])
            self.need = last + 4
            if len(self.rest) < self.need:
                return
            if self.rest[last : self.need] != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            header, block = bytes(self.rest[:end]), bytes(self.rest[end:last])
            del self.rest[: self.need]
            self.need = 0
            yield header, block

    def close(self) -> None:
        """The file ends. Its last line break has been put there by the reader if the file ends in half of one."""
        if bytes(self.rest).strip(b"\r\n"):
            raise ValueError("the last record is cut off")
        self.rest, self.need = bytearray(), 0


def _fields(header: bytes, block: bytes) -> tuple:
    name = lambda x: (_field(header, x) or "").strip("<>") or None
    return header, name(b"WARC-Record-ID"), name(b"WARC-Type"), _field(header, b"WARC-Target-URI"), name(b"WARC-Refers-To"), _field(header, b"WARC-Payload-Digest"), block


def read_warc(spark: SparkSession, path: str, batch: int = 500, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of all archives in a folder: exact header and block bytes, and the fields that joins need.

    Files named *.gz, which Spark does not split, are read as a stream of lines that end in two line breaks and put together again;
    any others are read whole.
    """
    packed = spark.read.option("lineSep", _END).option("pathGlobFilter", "*.gz").text(path)
    packed = packed.select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("value").cast("binary").alias("piece"))
    plain = spark.read.format("binaryFile").load(path).where(~F.col("path").endswith(".gz")).select("content")

    def batches_of(records):
        rows, size = [], 0
        for header, block in records:
            rows.append(_fields(header, block))
            size += len(header) + len(block)
            if len(rows) >= batch or size >= batch_bytes:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def stream(batches):
        cutter, now = _Cutter(), None
        for b in batches:
            for file, piece in zip(b.column(0).to_pylist(), b.column(1)):
                if file != now:
                    cutter.close()
                    now = file
                yield from cutter.feed(piece.as_buffer().to_pybytes() + b"\r\n\r\n")
        cutter.close()

    lines = packed.mapInArrow(lambda batches: batches_of(stream(batches)), RECORD)
    return lines.unionByName(plain.mapInArrow(lambda batches: batches_of(r for b in batches for content in b.column(0) for r in parse_records(content.as_py())), RECORD))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(zip(*rows), RECORD)], names=RECORD.names)


def store(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers), both written to the shared folder. payloads(digest, size, payload): one row for each distinct block that is
    not empty, by SHA-256 and length, in buckets of these. headers: every record's exact header bytes and fields, with the digest and
    size of its block. The archives are read once for each, so that no payload is written twice. Payloads are packed as tightly as in the
    archives, which lie on the disk at the same time."""
    spark = records.sparkSession
    keyed = records.withColumn("digest", F.sha2("block", 256)).withColumn("size", F.octet_length("block").cast("long"))
    once = keyed.where("size > 0").groupBy("digest", "size").agg(F.first("block").alias("payload"))
    name, buckets = f"loomgraph_payloads_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "digest", "size").option("path", scratch.new_path(spark, "payloads")).saveAsTable(name)
    return spark.table(name), scratch.cut(keyed.drop("block"), "headers")


def reconstruct(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """headers with the record's bytes as they were: header, block and the closing line breaks. A stored payload that
    no longer has its digest raises an error."""
    sound = F.when((F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("size")), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its digest says: "), F.col("digest"))).cast("binary"))
    full = headers.where("size > 0").join(payloads.select("digest", "size", sound.alias("block")), ["digest", "size"])
    empty = headers.where("size = 0").withColumn("block", F.lit(b""))
    return full.unionByName(empty).withColumn("record", F.concat("header", "block", F.lit(_END).cast("binary")))
