import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.warc import archive_records, read_warc, warc_round_trip, write_warc

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/\r\nX: y", ""), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"), (None, "v", "<p>x</p>"), (None, "w", "only null"), (6, "z", "é" * 100_000), (7, "z", "\r\n\r\n"), (7, "z", "\r\n\r\n")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_equals_brute_force(spark, tmp_path):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_round_trip(spark, pages(spark), str(tmp_path / "w")).collect()), key=str)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        f = first.get(h or "")
        revisit = f is not None and i != f
        want.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark, tmp_path):
    write_warc(archive_records(pages(spark), min_revisit_bytes=8), str(tmp_path / "w"))
    kinds = {(r.record_id, r.record_type) for r in read_warc(spark, str(tmp_path / "w")).collect()}
    assert ("urn:page:4", "response") in kinds and ("urn:page:2", "revisit") in kinds and ("urn:page:7", "response") in kinds


def test_filters_and_columns_are_pushed(spark, tmp_path):
    write_warc(archive_records(pages(spark)), str(tmp_path / "w"), compress=True)
    rows = read_warc(spark, str(tmp_path / "w"), ["record_type", "record_id", "target_uri"]).where(F.col("record_type") == "revisit")
    assert "record_type" in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.record_id for r in rows.collect()} == {"urn:page:2", "urn:page:", "urn:page:4"}
    held = read_warc(spark, str(tmp_path / "w")).where("content_length > 150000 AND payload_bytes = 200000").collect()
    assert [bytes(r.payload).decode() for r in held] == ["é" * 100_000]


def test_foreign_file(spark, tmp_path):
    (tmp_path / "f").mkdir()
    body = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\nX-Long: a\r\n b\r\n\r\nabc\r\n\r\n" b"WARC/1.0\nWARC-Type: resource\nContent-Type: text/plain\nContent-Length: 2\n\nhi\r\n\r\n"
    with gzip.open(tmp_path / "f" / "x.warc.gz", "wb") as f:
        f.write(body)
    got = {r.record_type: bytes(r.payload) for r in read_warc(spark, str(tmp_path / "f")).collect()}
    assert got == {"warcinfo": b"abc", "resource": b"hi"}
    (tmp_path / "f" / "y.warc").write_bytes(b"no record")
    with pytest.raises(Exception, match="record starts"):
        read_warc(spark, str(tmp_path / "f")).collect()


def test_empty_table(spark, tmp_path):
    assert warc_round_trip(spark, pages(spark, []), str(tmp_path / "w")).collect() == []
