import base64
import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import duckdb

from syncplan.llm.common import shared_dir
from syncplan.llm.warc import OP3_SQL, captures, op3_warc, read_records, transactions, write_warc


def _expected(pages):
    groups = defaultdict(list)
    for page, _, html in pages:
        groups[html or ""].append(page)
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        first = max((p for p in groups[html or ""] if p is not None), default=None)
        again = page != first and len(groups[html or ""]) > 1 and first is not None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page, len(raw), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op3_warc(spark, sf_dir).collect()), key=str) == _expected(pages)


def test_odd_pages_and_nested_rows(spark):
    pages = [(1, "http://a.b/c?d#e", "x\r\n\r\nWARC/1.1\r\n\r\n"), (2, None, None), (3, "u v\r\nw", ""), (7, "q", "é" * 70000),
             (7, "q", "é" * 70000), (9, "q", "é" * 70000), (None, "n", "only null"), (None, "n", "é" * 70000)]
    path = shared_dir(spark)
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, first string")
    write_warc(df, path)
    got = captures(spark, path)
    rows = [
        (int(f["page-id"]) if "page-id" in (f := r["metadata"]["fields"]) else None, int(f["payload-bytes"]),
         r["main"]["payload_digest"], r["main"]["type"], int(f["refers-to-page"]) if "refers-to-page" in f else None)
        for r in got.collect()
    ]
    assert sorted(rows, key=str) == _expected(pages)
    assert all(r["request"]["concurrent_to"] == r["main"]["record_id"] for r in got.collect())
    ids = {r["record_id"] for r in read_records(spark, path).filter("type = 'response'").collect()}
    assert {r["refers_to"] for r in read_records(spark, path).filter("type = 'revisit'").collect()} <= ids
    for file in Path(path.removeprefix("file://")).glob("part-*"):
        whole = gzip.decompress(file.read_bytes())
        assert not whole or whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n")


def test_small_payloads_and_missing_main(spark):
    path = shared_dir(spark)
    df = spark.createDataFrame([(1, "a", "xy"), (2, "a", "xy"), (3, "a", "xyz"), (4, "a", "xyz")], "page_id long, url string, html string")
    write_warc(df, path, revisit_bytes=3)
    kinds = {int(r["metadata"]["fields"]["page-id"]): r["main"]["type"] for r in captures(spark, path).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    alone = transactions(read_records(spark, path).filter("type = 'request'")).collect()
    assert len(alone) == 4 and all(r["main"] is None and r["request"] is not None for r in alone)


def test_one_page_under_several_urls(spark):
    """Equal page ids and payloads, other URLs: each is a capture of its own, and revisits name one of them."""
    path = shared_dir(spark)
    df = spark.createDataFrame([(5, "http://a/", "x"), (5, "http://b/", "x"), (5, None, "x"), (2, "http://c/", "x")], "page_id long, url string, html string")
    write_warc(df, path)
    got = captures(spark, path).collect()
    assert sorted((r["main"]["type"], r["main"]["target"], r["request"]["target"]) for r in got) == [("response", "", ""), ("response", "http://a/", "http://a/"), ("response", "http://b/", "http://b/"), ("revisit", "http://c/", "http://c/")]
    ids = {r["main"]["target"]: r["main"]["record_id"] for r in got}
    assert len(set(ids.values())) == 4
    assert [r["main"]["refers_to"] for r in got if r["main"]["type"] == "revisit"] == [ids["http://b/"]]


def test_empty(spark):
    path = shared_dir(spark)
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert captures(spark, path).count() == 0


def test_whole_table_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    rows = op3_warc(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({OP3_SQL})").fetchall()
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)
