import gzip
import hashlib
import os
import tempfile

import pytest

from plumbline.llm.warc import read_warc, write_warc

COLUMNS = ["id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]


@pytest.fixture
def folder():
    return os.path.join(tempfile.mkdtemp(prefix="warc-"), "out")


def _pages(spark):
    big = "x" * 1500
    rows = [
        (1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""),
        (None, "u", big), (8, "u", "é" * 600), (9, "u", "é" * 600), (9, "u", "é" * 600), (None, "u", "alone " * 300), (10, "u", "\r\n\r\nWARC/1.1 " * 5000),
    ]
    return spark.createDataFrame([(*r, "response", 0) for r in rows], "page_id long, url string, html string, record_type string, payload_bytes int")


def _want(rows):
    groups = {}
    for r in rows:
        if len((r["html"] or "").encode()) >= 1000 and r["page_id"] is not None:
            groups[r["html"]] = max(groups.get(r["html"], -1), r["page_id"])
    out = []
    for r in rows:
        payload = (r["html"] or "").encode()
        last = groups.get(r["html"])
        revisit = last is not None and last != r["page_id"]
        out.append((None if r["page_id"] is None else str(r["page_id"]), "revisit" if revisit else "response", len(payload), hashlib.sha1(payload).hexdigest(), str(last) if revisit else None, None if revisit else payload))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [1 << 24, 97, 1])
def test_round_trip_by_any_range(spark, folder, range_bytes):
    pages = _pages(spark)
    rows = pages if range_bytes > 1 else pages.where("length(html) < 10")
    write_warc(rows.coalesce(1), folder)
    got = read_warc(spark, folder, range_bytes).collect()
    plain = sorted(((r["id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=repr)
    assert plain == _want(rows.collect())


def test_files_are_plain_gzip_members(spark, folder):
    write_warc(_pages(spark), folder)
    for name in os.listdir(folder):
        if name.startswith("part-") and os.path.getsize(f"{folder}/{name}"):
            with gzip.open(f"{folder}/{name}") as f:
                assert f.read().startswith(b"WARC/1.1\r\n")


def test_empty_table(spark, folder):
    write_warc(_pages(spark).limit(0), folder)
    assert read_warc(spark, folder).collect() == []


def test_payload_that_holds_gzip_magic_and_foreign_archives(spark, folder):
    """Members of any writer, false magics inside a member, other members between."""
    os.makedirs(folder)
    inner = b"\x1f\x8b\x08" * 500 + gzip.compress(b"not a record")
    def record(i, body):
        return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:={i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    with open(f"{folder}/some.warc.gz", "wb") as f:
        for i in range(30):
            f.write(gzip.compress(record(i, inner * (i % 3)), compresslevel=0 if i % 2 else 6))
            f.write(gzip.compress(b"no record"))
    for size in (1 << 20, 1000, 37):
        got = sorted((int(r["id"]), r["payload_bytes"], r["payload_digest"]) for r in read_warc(spark, folder, size).collect())
        assert got == [(i, len(inner) * (i % 3), hashlib.sha1(inner * (i % 3)).hexdigest()) for i in range(30)]


def test_members_of_16_mb(spark, folder):
    df = spark.createDataFrame([(1, "u", "a" * (17 << 20)), (2, "u", "b")], "page_id long, url string, html string")
    write_warc(df, folder)
    assert {r["id"]: r["payload_bytes"] for r in read_warc(spark, folder, 1 << 12).select("id", "payload_bytes").collect()} == {"1": 17 << 20, "2": 1}
