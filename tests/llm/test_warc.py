"""Archives: exact round trips, revisits, and records that are not as they should be."""

import base64
import gzip
import hashlib

import pytest

from quaestor.llm import warc

SCHEMA = "page_id long, url string, html string"


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def test_round_trip(spark):
    odd = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nb\x00é😀"
    rows = [
        (1, "http://a.b/c?d#e", odd), (2, "https://x", "same"), (9, "http://y/", "same"), (5, None, "same"),
        (3, "http://n\r\nEvil: 1", None), (4, "u", ""), (None, "http://z", "same"), (None, "http://q", "own"), (6, "", "x" * 300_000),
        (2, "https://x", "same"),
    ]
    found = warc.captures_of(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r.page_id, r.payload_digest): r for r in found}
    assert len(found) == len(got) == 9
    for page, _, html in rows:
        html = html or ""
        r = got[page, sha(html)]
        assert r.payload_bytes == len(html.encode())
        first = {"same": 9, "": 4}.get(html, page)
        assert r.record_type == ("response" if page == first else "revisit")
        assert r.refers_to == (None if page == first else first)
        assert r.payload == (html.encode() if page == first else None)
        assert r.intact is (True if page == first else None)


def test_transactions_are_whole(spark):
    pages = spark.createDataFrame([(1, "http://a/b", "x"), (2, "http://a/c", "x")], SCHEMA)
    rows = warc.assemble(warc.read_records(spark, warc.write_archives(pages))).collect()
    assert {r.request.target_uri for r in rows} == {"http://a/b", "http://a/c"}
    assert {r.metadata.fields["page_id"] for r in rows} == {"1", "2"}
    assert {r.response.record_type for r in rows} == {"response", "revisit"}


def test_missing_and_orphaned_records(spark):
    kinds = [("response", "r1", None), ("response", "r1", None), ("request", "q1", "r1"), ("request", "q2", "gone"), ("revisit", "r2", None), ("metadata", "m1", None)]
    records = spark.createDataFrame(
        [(k, i, c, None, "u", "D", 1, None, None, None) for k, i, c in kinds], warc.RECORDS
    )
    rows = {r.record_id: r for r in warc.assemble(records).collect()}
    assert set(rows) == {"r1", "r2"} and rows["r1"].request.record_id == "q1"
    assert rows["r1"].metadata is None and rows["r2"].request is None


def test_damage_is_noticed():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    (row,) = warc.parse(gzip.compress(head % (len(block), block)))
    assert row[8] is False and row[7] == b"body"
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(head % (len(block) + 99, block))))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"nothing")))


def test_archives_are_parsed_again_for_payloads_only(spark):
    found = warc.captures_of(spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], SCHEMA))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(found).count("MapInArrow") == 1
    assert "MapInArrow" not in plan(found.drop("payload", "intact"))


def test_no_pages(spark):
    assert warc.captures_of(spark.createDataFrame([], SCHEMA)).count() == 0
