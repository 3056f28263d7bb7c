import base64
import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest

from tarn.llm import warc

PAGES = [(1, "http://a.example/x?y#z", "<p>one</p>"), (2, "http://b.example/", "<p>one</p>"), (3, None, None), (4, "http://c.example", ""), (5, "http://d.example/\r\nWARC-Type: x", "a\r\n\r\nWARC/1.1\r\nb\r\n\r\n"), (6, "http://e.example/é", "é" * 3000), (6, "http://e.example/é", "é" * 3000), (None, "http://f.example/", "<p>one</p>")]


def wanted(rows, least=0):
    best = {}
    for i, html in rows:
        key = html or ""
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        first = best[html or ""] == i or len(raw) < least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else best[html or ""]))
    return sorted(out, key=str)


def test_query_against_a_dictionary(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = warc.op1_warc(spark, str(tmp_path)).collect()
    assert wanted([(p[0], p[2]) for p in PAGES]) == sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


def test_captures(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:6], "page_id long, url string, html string")
    path = warc.write_captures(pages, f"{tmp_path}/warc", least_bytes=1)
    records = warc.read_records(spark, path).cache()
    assert records.count() == 18 and records.where("digest_ok = false").count() == 0
    rows = warc.assemble(records).collect()
    assert len(rows) == 6 and all(len(r["requests"]) == 1 and len(r["metadata"]) == 1 for r in rows)
    by_payload = {bytes(r["response"]["payload"]) for r in rows if r["response"]["type"] == "response"}
    assert by_payload == {(p[2] or "").encode() for p in PAGES[:6]}
    assert sum(r["response"]["type"] == "revisit" for r in rows) == 1  # empty payloads are too small to be revisits
    assert sorted(r["response"]["target_uri"] or "" for r in rows)[-2] == "http://d.example/%20%20WARC-Type: x"


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = warc.write_captures(pages, f"{tmp_path}/warc")
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


def test_links_of_either_direction(spark):
    record = lambda i, kind, *to: (i, kind, list(to), *[None] * 8)
    rows = [record("r1", "response", "q1"), record("q1", "request"), record("m1", "metadata", "q1"), record("r2", "revisit"), record("q2", "request", "r2"), record("m2", "metadata", "q2"), record("m3", "metadata", "nowhere"), record("w", "warcinfo")]
    got = {r["capture_id"]: (r["response"] and r["response"]["record_id"], [x["record_id"] for x in r["requests"] or []], [x["record_id"] for x in r["metadata"] or []]) for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {"r1": ("r1", ["q1"], ["m1"]), "r2": ("r2", ["q2"], ["m2"]), "m3": (None, [], ["m3"])}


def test_crowded_captures_have_parts(spark):
    record = lambda i, kind, *to: (i, kind, list(to), *[None] * 8)
    rows = [record("r1", "response"), record("r2", "response"), *[record(f"m{i:03}", "metadata", "r1") for i in range(300)], record("q", "request", "r2"), *[record("twin", "metadata", None)] * 50]
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORD), attached=40).collect()
    parts = [r for r in got if r["capture_id"] == "r1"]
    assert sorted(r["part"] for r in parts) == list(range(8)) and [r["part"] for r in parts if r["response"]] == [0]
    assert sorted(x["record_id"] for r in parts for x in r["metadata"]) == [f"m{i:03}" for i in range(300)] and max(len(r["metadata"]) for r in parts) < 80
    assert [(r["part"], [x["record_id"] for x in r["requests"]]) for r in got if r["capture_id"] == "r2"] == [(0, ["q"])]
    assert sum(len(r["metadata"]) for r in got if r["capture_id"] == "twin") == 50


def test_archives_are_bounded_and_members_stand_alone(spark, tmp_path):
    rows = [(i, f"http://x.example/{i}", random.Random(i).randbytes(10_000).hex()) for i in range(40)] + [(100, "http://long.example/", "é" * 9_000_000), (101, "http://long.example/2", "no end " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_captures(pages, f"{tmp_path}/warc", file_bytes=50_000)
    files = [f.read_bytes() for f in Path(path).glob("part-*")]
    assert len(files) > 8 and max(map(len, files)) < 150_000
    members = 0
    for content in files:
        while content:
            stream = zlib.decompressobj(31)
            record = stream.decompress(content) + stream.flush()
            assert not record or (record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n"))
            members, content = members + bool(record), stream.unused_data
    assert members == 3 * len(rows)
    assert warc.read_records(spark, path).where("digest_ok").count() == len(rows)


def test_columns_named_like_the_operators(spark, tmp_path):
    rows = [(i, "http://a.example/", "same", "k", "b", 3, "x") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, capture string, nth int, id string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r["page_id"], r["record_type"]) for r in warc.op1_warc(spark, str(tmp_path)).collect()) == [(0, "revisit"), (1, "revisit"), (2, "response")]


def test_parser():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <x>\r\nWARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for content in (record * 2, gzip.compress(record) + gzip.compress(record)):
        got = list(warc.parse_archive(content))
        assert len(got) == 2 and got[0][1] == b"abc" and got[0][0]["warc-concurrent-to"] == ["<a>", "<b>"]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_archive(record[:-6]))
    with pytest.raises(ValueError, match="begins"):
        list(warc.parse_archive(b"HTTP/1.1 200 OK\r\n"))
