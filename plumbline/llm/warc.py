"""WARC archives: a writer on Spark's own file output, and a splittable reader of gzip members.

*Writing.* One gzip member per record. Equal payloads of at least MIN_REVISIT bytes are stored once:
the record with the largest key is a response, the others revisit it. Members go out through
Spark's text writer, so that a repeated task leaves no second copy and any file system that Spark
can write will do: the last byte of a member (the high byte of its length) is 0 and is supplied as the
line separator; a member of 16 MB or more is followed by an empty one, which ends in 0 as well.

*Reading.* Files are listed by Spark and cut into byte ranges. A task scans its range for the
gzip magic, takes a place for a member only if it decompresses to a WARC header, and owns the
records that start inside its range, reading on beyond the end for the last of them. Within a
record that it owns it looks for no other. Archives may have any name.

Defined cases: null html is an empty payload; a null url leaves out the target header; rows that
share the largest key and the payload are all responses; a null key stays null and never is the
largest, unless all keys of the group are null, which makes all of them responses; an empty table
gives an archive without records; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, stored

MIN_REVISIT = 1000  # bytes of payload from which equal ones are stored once
RANGE_BYTES = 16 << 20  # of an archive that one task scans
CHUNK = 1 << 20  # bytes read at a time
# The gzip magic with the deflate method, the names of the WARC format.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-page:"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(record) + packer.flush()
    return member if member[-1] == 0 else member + _member(b"")


def _record(key: str | None, refers: str | None, url: str | None, digest: str, length: int, payload: bytes | None, date: str) -> bytes:
    """A response with its payload, or a revisit of `refers` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if key is None else '=' + quote(key, safe='')}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if payload is None:
        head += [f"WARC-Refers-To: <{URN}={quote(refers, safe='')}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _members(date: str):
    def task(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out, size, columns = [], 0, [batch.column(n).to_pylist() for n in ("key", "refers", "url", "digest", "length", "payload")]
            for key, refers, url, digest, length, payload in zip(*columns):
                out.append(_member(_record(key, refers, url, digest, length, payload, date))[:-1])
                size += len(out[-1])
                if size > 4 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    return task


def write_warc(df: DataFrame, path: str, key: str = "page_id", html: str = "html", url: str | None = "url", date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of `df` into the new folder `path`."""
    payload = F.encode(F.coalesce(quoted(html), F.lit("")), "UTF-8")
    rows = df.select(
        quoted(key).alias("key"), (quoted(url) if url else F.lit(None)).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("same"), F.octet_length(payload).cast("long").alias("length"),
    )
    # only repeated payloads; stored first, so that its size decides how it is joined
    repeated = rows.where(F.col("length") >= MIN_REVISIT).groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last"))
    repeated = stored(repeated.where("n > 1").select(F.col("same").alias("_same"), "last"), "warc-repeated")
    joined = rows.join(repeated, (F.col("same") == F.col("_same")) & (F.col("length") >= MIN_REVISIT), "left")
    first = F.col("last").isNull() | F.col("key").eqNullSafe(F.col("last"))
    records = joined.select(
        F.col("key").cast("string").alias("key"), F.when(~first, F.col("last").cast("string")).alias("refers"), "url",
        F.sha1("payload").alias("digest"), "length", F.when(first, F.col("payload")).alias("payload"),
    )
    members = records.mapInArrow(_members(date), "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Range:
    """Bytes of a file from a start onwards, read as they are needed."""

    def __init__(self, file, start: int, size: int) -> None:
        self.file, self.start, self.size, self.data = file, start, size, bytearray()

    def upto(self, offset: int) -> bool:
        """Have the bytes before `offset`, as far as the file goes; False if it ends sooner."""
        offset_in, end = offset - self.start, self.start + len(self.data)
        while len(self.data) < offset_in and end < self.size:
            got = self.file.read_at(min(max(CHUNK, offset - end), self.size - end), end)
            if not got:
                break
            self.data += got
            end += len(got)
        return len(self.data) >= offset_in

    def forget(self, offset: int) -> None:
        del self.data[: offset - self.start]
        self.start = offset

    def member(self, at: int) -> tuple[bytes, int] | None:
        """What the member at `at` holds and where it ends; None if no WARC record starts here."""
        opener, out, pos, checked = zlib.decompressobj(31), [], at, False
        while not opener.eof:
            if not self.upto(pos + 1):
                return None
            chunk = bytes(self.data[pos - self.start : pos - self.start + CHUNK // 8])
            try:
                out.append(opener.decompress(chunk))
            except zlib.error:
                return None
            pos += len(chunk)
            if not checked:
                head = b"".join(out)[:7]
                if not b"WARC/1.".startswith(head):
                    return None
                checked = len(head) == 7
        return (b"".join(out), pos - len(opener.unused_data)) if checked else None


def _parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    http, blank, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    if kind == "revisit":
        told = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length = int(told[0]) if told else None
        digest, payload = fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
    else:
        payload = payload if blank and "application/http" in fields.get("content-type", "") else block
        length, digest = len(payload), hashlib.sha1(payload).hexdigest()

    def page(name):
        urn = fields.get(name, "").strip("<>").removeprefix(URN)
        return unquote(urn[1:]) if urn.startswith("=") else None

    return page("warc-record-id"), kind, fields.get("warc-target-uri"), length, digest, page("warc-refers-to"), payload


def _scan(batches) -> Iterator:
    """Byte ranges (path, start, stop, size) -> the records that start inside."""
    import pyarrow as pa
    from pyarrow import fs

    names = ["file", "place", "id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def arrow(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for path, start, stop, size in zip(*[batch.column(n).to_pylist() for n in ("path", "start", "stop", "size")]):
            system, inside = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with system.open_input_file(inside) as file:
                view, at = _Range(file, start, size), start
                while at < stop:
                    view.upto(min(at + CHUNK, stop + len(MAGIC) - 1))
                    found = view.data.find(MAGIC, at - view.start)
                    if found < 0:
                        at = max(at + 1, view.start + len(view.data) - len(MAGIC) + 1)
                    elif (at := view.start + found) < stop:
                        got = view.member(at)
                        if got is None:
                            at += 1
                        else:
                            rows.append((path, at, *_parse(got[0])))
                            held, at = held + len(got[0]), got[1]
                    view.forget(min(at, view.start + len(view.data)))
                    if held > 4 * CHUNK:
                        yield arrow(rows)
                        rows, held = [], 0
            if rows:
                yield arrow(rows)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives below `path`: file, place, id, record_type, url, payload_bytes,
    payload_digest, refers_to, payload (null for a revisit)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", F.col("length").alias("size"), starts.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("stop"), "size")
    dealt = ranges.repartition(max(2, 2 * spark.sparkContext.defaultParallelism))
    return dealt.mapInArrow(_scan, "file string, place long, id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")
