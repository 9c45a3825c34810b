"""WARC archives of page captures, and their assembly into transactions.

Each capture has three records: a request, a response (or a revisit of a response with the same payload) and metadata.
Request and metadata name the response or revisit in ``WARC-Concurrent-To``.  Archives are gzip files with a member
for each record (and an empty one after each capture).  Reading parses every record, then joins the records of a capture
through the concurrent-to identifiers into one nested row.

Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest page id is the response; the id
of a response is made of its page, URL and payload, so a revisit names it without looking it up.

Nulls and odd input: a null html is an empty payload, a null url an empty target; a page with a null page id is a capture
of its own and the response of a payload only if all its pages are such; of rows with the largest page id each is a
response, under an id of its own if their URLs differ; repeated rows are one record, written as often.  An empty table gives no captures.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_files import read_files, write_blocks
from .common import positional, read_table, shared_dir

#: What a file holds before compression, about.
FILE_BYTES = 32 << 20
#: The gzip encoding of nothing: it may stand between members.
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x02\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _record(kind: str, record_id: str, date: str, headers: list[tuple[str, str]], content: bytes) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        *(f"{k}: {v}" for k, v in headers),
        f"Content-Length: {len(content)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"


def _response_id(page_id: int | None, url: str | None, digest: str) -> str:
    return uuid.UUID(bytes=hashlib.md5(f"{page_id} {digest} {url}".encode()).digest(), version=4).urn


def _capture(page_id: int | None, url: str | None, html: str | None, first: int | None, first_url: str | None, revisit: bool, date: str) -> bytes:
    """``first``, ``first_url``: the page and URL of the response with this payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = _digest(payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    where = [("WARC-Target-URI", target)]
    sha = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {"page-id": page_id, "payload-bytes": len(payload)}
    if revisit:
        main_id = uuid.uuid4().urn
        back = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{_response_id(first, first_url, digest)}>"),
        ]
        main = _record("revisit", main_id, date, where + back + sha, head)
        fields["refers-to-page"] = first
    else:
        main_id = _response_id(page_id, url, digest)
        main = _record("response", main_id, date, where + sha, head + payload)
    beside = [*where, ("WARC-Concurrent-To", f"<{main_id}>")]
    rest = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)", target)
    ask = f"GET {rest[2] or '/'} HTTP/1.1\r\nHost: {rest[1]}\r\n\r\n".encode()
    request = _record("request", uuid.uuid4().urn, date, [*beside, ("Content-Type", "application/http; msgtype=request")], ask)
    told = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode()
    metadata = _record("metadata", uuid.uuid4().urn, date, [*beside, ("Content-Type", "application/warc-fields")], told)
    return _member(request) + _member(main) + _member(metadata)


def _captures(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                blocks = [_capture(*row, date) for row in zip(*part.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])

    return run


def write_warc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    revisit_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
) -> None:
    pages, (page_id, url, html) = positional(pages, page_id, url, html)
    slim = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    size = F.octet_length("html")
    # summed before the shuffle, so one payload of a third of all pages is no hot group
    groups = slim.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n"), F.sum(size).alias("bytes"))
    totals = slim.agg(F.count("*"), F.sum(size)).first()
    per_file = max(1, int(FILE_BYTES / max(1.0, (totals[1] or 0) / max(1, totals[0]) + 1200)))
    again = groups.filter((F.col("n") > 1) & (F.col("bytes") >= F.col("n") * revisit_bytes)).select("sha", F.col("top.page_id").alias("first"), F.col("top.url").alias("first_url"))
    # adaptive execution broadcasts the groups if they turn out small, and splits a hot group otherwise
    rows = slim.join(again, "sha", "left").select(
        "page_id",
        "url",
        "html",
        "first",
        "first_url",
        (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"),
    )
    blocks = rows.mapInArrow(_captures(date), "block binary")
    write_blocks(blocks, path, "block", _EMPTY_MEMBER, maxRecordsPerFile=per_file)


RECORD = (
    "file string, at long, type string, record_id string, concurrent_to string, refers_to string, target string,"
    " date string, payload_digest string, payload_bytes long, fields map<string,string>"
)


def _members(data: memoryview) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        reader, begin, parts, step = zlib.decompressobj(31), at, [], 1 << 10
        while not reader.eof and at < len(data):
            chunk = data[at : at + step]
            step = min(2 * step, 1 << 18)
            parts.append(reader.decompress(chunk))
            at += len(chunk) - len(reader.unused_data)
        if not reader.eof:
            raise ValueError(f"the member at byte {begin} is cut off")
        yield begin, b"".join(parts)


def _parse(path: str, at: int, record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    content = rest[: int(headers["content-length"])]
    if not version.startswith("WARC/") or rest[len(content) :] != b"\r\n\r\n":
        raise ValueError(f"{path}: no whole record at byte {at}")
    kind = headers["warc-type"]
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    out = {
        "file": path,
        "at": at,
        "type": kind,
        "record_id": bare("warc-record-id"),
        "concurrent_to": bare("warc-concurrent-to"),
        "refers_to": bare("warc-refers-to"),
        "target": headers.get("warc-target-uri"),
        "date": headers.get("warc-date"),
        "payload_digest": None,
        "payload_bytes": None,
        "fields": None,
    }
    if kind == "response":
        payload = content.partition(b"\r\n\r\n")[2]
        out |= {"payload_digest": _digest(payload), "payload_bytes": len(payload)}
        if headers["warc-payload-digest"] != f"sha1:{out['payload_digest']}":
            raise ValueError(f"{path}: the payload at byte {at} is damaged")
    elif kind == "revisit":
        out["payload_digest"] = headers["warc-payload-digest"].removeprefix("sha1:")
    elif kind == "metadata":
        out["fields"] = list(tuple(x.split(": ", 1)) for x in content.decode().splitlines() if x)
    return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 7, pa.int64(), pa.map_(pa.string(), pa.string())]
    names = [x.split()[0] for x in RECORD.replace("<string,string>", "").split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows: list[dict] = []
            for at, record in _members(memoryview(content.as_buffer())):
                if record:
                    rows.append(_parse(path, at, record))
                if len(rows) >= 3000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives: RECORD.  Digests and sizes of responses are taken from their payloads."""
    return read_files(spark, path).mapInArrow(_records, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One row for each capture: its id and the structs ``main`` (response or revisit), ``request`` and ``metadata``.

    Records meet under the id that they are concurrent to; partial aggregation comes before the shuffle.  A request or
    metadata record whose capture is missing gives a row with a null ``main``.
    """
    whole = F.struct(*(c for c in records.columns))
    of = lambda *kinds: F.max_by(F.when(F.col("type").isin(*kinds), whole), F.when(F.col("type").isin(*kinds), F.col("at")))
    return (
        records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
        .groupBy("capture_id")
        .agg(
            of("response", "revisit").alias("main"),
            of("request").alias("request"),
            of("metadata").alias("metadata"),
            F.count_if(F.col("type").isin("response", "revisit")).alias("copies"),
        )
    )


def captures(spark: SparkSession, path: str) -> DataFrame:
    """``transactions`` of the archives; a capture written several times (repeated rows) comes as often."""
    rows = transactions(read_records(spark, path))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int"))))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_warc(read_table(spark, sf_dir, "pages"), path)
    field = lambda name: F.try_element_at("metadata.fields", F.lit(name)).cast("long")
    return captures(spark, path).select(
        field("page-id").alias("page_id"),
        F.coalesce("main.payload_bytes", field("payload-bytes")).alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        field("refers-to-page").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top, sha1(x) AS h FROM p),
b AS (  -- the digest in bits
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
         4 * (instr('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), '') AS bits FROM r
)
SELECT page_id, strlen(x) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5),
         lambda j: CAST(substr(bits, 5 * k + j + 1, 1) AS INTEGER) * (16 >> j))) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
