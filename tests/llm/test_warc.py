import gzip
import hashlib

import pytest
from loomgraph.llm import queries, warc

BIG = "x" * 1000


def write(frame, tmp_path, *rows, **k):
    path = str(tmp_path / "w")
    warc.write_warc(warc.pages_to_records(frame("page_id long, url string, html string, size int, sha256 string, body string, id string", *[(i, u, h, 1, "s", "b", "z") for i, u, h in rows])), path, **k)
    return path


def test_round_trip(spark, frame, tmp_path):
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\nWARC/1.1\r\n\r\n" + "é\0漢😀"
    rows = [(1, "http://a/", tricky), (2, None, None), (3, "u\r\nX: y", ""), (4, "u", BIG), (9, "u", BIG), (5, "v", BIG), (6, "u", "x" * 999), (7, "u", "x" * 999), (-8, "u", "-8"), (None, "u", "gone")]
    path = write(frame, tmp_path, *rows, rows_per_file=2)
    back = warc.reconstruct(*warc.store(warc.read_warc(spark, path))).collect()
    got = {r.record_id: r for r in back}
    assert len(back) == 10 and [bytes(r.block) for r in back if r.record_id.startswith("urn:page:#")] == [b"gone"]
    want = {i: (h or "").encode() for i, _, h in rows if i is not None}
    for i, body in want.items():
        r = got[f"urn:page:{i}"]
        revisit = i in (4, 5)
        assert r.record_type == ("revisit" if revisit else "response") and bytes(r.block) == (b"" if revisit else body)
        assert r.refers_to == ("urn:page:9" if revisit else None)
        assert bytes(r.record) == bytes(r.header) + bytes(r.block) + b"\r\n\r\n"
    assert got["urn:page:3"].target_uri == "u%0D%0AX: y" and got["urn:page:2"].target_uri is None


def test_payloads_are_stored_once_and_verified(spark, frame, tmp_path):
    records = warc.read_warc(spark, write(frame, tmp_path, (1, "u", "same"), (2, "u", "same"), (3, "u", None)))
    payloads, headers = warc.store(records)
    assert [bytes(r.payload) for r in payloads.collect()] == [b"same"] and headers.count() == 3
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="payload is not what"):
        warc.reconstruct(payloads.withColumn("payload", F.lit(b"lame")), headers).collect()


def test_stored_payloads_are_packed(spark, frame, tmp_path):
    import pyarrow.parquet as pq

    payloads, _ = warc.store(warc.read_warc(spark, write(frame, tmp_path, (1, "u", BIG), (2, "u", "small"))))
    groups = [m.row_group(g) for m in (pq.ParquetFile(p.removeprefix("file://")).metadata for p in payloads.inputFiles()) for g in range(m.num_row_groups)]
    assert groups and {g.column(c).compression for g in groups for c in range(g.num_columns)} == {"ZSTD"}


def test_rows_that_share_an_id_are_records_of_their_own(spark, frame, tmp_path):
    b, c = "b" * 1000, "c" * 1500
    rows = [(9, "u", b), (9, "u", b), (5, "u", b), (7, "u", c), (7, "v", "small"), (None, "u", c), (None, None, None), (3, "u", c)]
    frame("page_id long, url string, html string, size int", *[(*r, 1) for r in rows]).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, queries.op1_warc(spark, str(tmp_path)).collect()), key=repr)
    sha1 = lambda x: hashlib.sha1(x.encode()).hexdigest()
    want = [(9, 1000, sha1(b), "response", None), (9, 1000, sha1(b), "revisit", 9), (5, 1000, sha1(b), "revisit", 9), (7, 1500, sha1(c), "response", None), (7, 5, sha1("small"), "response", None), (None, 1500, sha1(c), "revisit", 7), (None, 0, sha1(""), "response", None), (3, 1500, sha1(c), "revisit", 7)]
    assert got == sorted(want, key=repr)


def test_one_huge_payload_and_odd_line_breaks(spark, frame, tmp_path):
    odd = ["\r\n", "a\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "a\r\n\r\n\r", "\n\r\n", "x\r", "WARC/1.1\r\n\r\n\r\n\r\n"]
    huge = "".join(f"<p>{i}\r\n\r\n" for i in range(400_000))
    rows = [(i, "u", t) for i, t in enumerate([huge, *odd])]
    for n in (1, 3, 100):
        back = warc.read_warc(spark, write(frame, tmp_path / str(n), *rows, rows_per_file=n)).collect()
        assert {int(r.record_id.split(":")[-1]): bytes(r.block).decode() for r in back} == {i: t for i, _, t in rows}


def test_plain_and_packed_archives_in_one_folder(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\ncontent-length: 3\r\n\r\n\xff\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record * 2))
    assert [bytes(r.block) for r in warc.read_warc(spark, str(tmp_path)).collect()] == [b"\xff\r\n"] * 5
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record + record[:-9]))
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_foreign_archives():
    record = b"WARC/1.0\r\nWARC-Type: response\r\ncontent-length: 3\r\n\r\na\r\n\r\n\r\n"
    assert [b for _, b in warc.parse_records(record * 2)] == [b"a\r\n"] * 2
    assert len(list(warc.parse_records(gzip.compress(record) + gzip.compress(record)))) == 2
    for broken in (record[:-1], gzip.compress(record)[:-3], b"x" + record, record.replace(b"3", b"9")):
        with pytest.raises(ValueError):
            list(warc.parse_records(broken))


def test_empty_table(spark, frame, tmp_path):
    assert warc.read_warc(spark, write(frame, tmp_path)).count() == 0
