import datetime
from decimal import Decimal, localcontext

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syncplan.functions import paths as P
from syncplan.functions import values as V
from syncplan.plans.queries import QUERIES


def _map(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").withColumn("out", fn(F.col("v"))).orderBy("i")
    return [r["out"] for r in rows.collect()]


def test_path_parts(spark):
    paths = ["a/b/c.tar.gz", "top.jpg", ".gitignore", "a/.env", "a/b", "", None]
    assert _map(spark, paths, P.stem) == ["a/b/c.tar", "top", "", "a/", "a/b", "", None]
    assert _map(spark, paths, P.directory) == ["a/b", "", "", "a", "a", "", None]
    assert _map(spark, paths, P.extension) == ["gz", "jpg", "gitignore", "env", "", "", None]
    assert _map(spark, ["a/b.jpg", "", ".", "/", "x/"], P.basename) == ["b.jpg", "upload", "upload", "upload", "x"]
    assert _map(spark, ["a/b/c"], lambda c: P.segment(c, -1)) == ["c"]


def test_sanitize(spark):
    assert _map(spark, ['a<b>c:d"e/f\\g|h?i*j.png', "x\r\ny", "Ünï.jpg"], P.sanitize_filename) == ["a_b_c_d_e_f_g_h_i_j.png", "x__y", "Ünï.jpg"]
    assert _map(spark, ["d/a:b.png", "d/ok.png"], P.rename_warning) == ['filename rewritten: "a:b.png" -> "a_b.png"', None]


def test_keys_and_scopes(spark):
    assert _map(spark, ["x/y"], lambda c: P.full_key(c, "/p/q/")) == ["p/q/x/y"]
    assert _map(spark, ["p/q/x/y", "p/qq/x", "p/q"], lambda c: P.rel_key(c, "p/q")) == ["x/y", None, ""]
    assert _map(spark, ["hot", "hot/a", "hotel/a"], lambda c: P.is_under(c, "hot")) == [True, True, False]
    assert _map(spark, ["", "hot", None], lambda c: P.scope_key(F.lit("s3"), c)) == ["s3", "s3#hot", "s3"]
    assert _map(spark, ['"abc"', "abc"], P.trim_etag) == ["abc", "abc"]


def test_redaction(spark):
    got = _map(spark, ["GET https://h/p?sig=1&x=2 failed", "plain text"], P.redact_urls)
    assert got == ["GET https://h/p?<redacted> failed", "plain text"]


def test_canonical(spark):
    assert _map(spark, ["Topics  >  Sports", " topics / sports / football "], V.canonical_path) == ["topics/sports", "topics/sports/football"]
    assert _map(spark, ["  Caption\t"], V.canonical_field_name) == ["caption"]


def test_plain_number(spark):
    values = ["1234", "3.14", "1.5E7", "3.0", "-0.0", "+007", "0.00000001", "", "abc", "12345678901234567890123456789012345678", "-12.500"]
    want = ["1234", "3.14", "15000000", "3", "0", "7", "0.00000001", None, None, "12345678901234567890123456789012345678", "-12.5"]
    assert _map(spark, values, V.plain_number) == want
    values = ["1" * 40 + ".5", "1e30", "-1e-19", "0.0000000000000000001", ".5", "5.", "1.e2", "12.50e-1", "-0e9", "1e400", "1e401", "1e99999999999", ".", "e5", "1 2", "NaN", "-00012.300E+1"]
    assert _map(spark, values, V.plain_number) == [None if v in ("1e401", "1e99999999999", ".", "e5", "1 2", "NaN") else _plain(v) for v in values]


def _plain(text):
    out = format(Decimal(text), "f")
    out = out.rstrip("0").rstrip(".") if "." in out else out
    return out.removeprefix("-") if not Decimal(text) else out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.builds(lambda s, a, b, e: f"{s}{a}{b}{e}", st.sampled_from(["", "+", "-"]), st.from_regex(r"\A[0-9]{1,45}\Z"), st.from_regex(r"\A(\.[0-9]{0,45})?\Z"), st.from_regex(r"\A([eE][+-]?[0-9]{1,2})?\Z")), min_size=200, max_size=200))
def test_plain_numbers_of_any_size(spark, values):
    with localcontext() as c:
        c.prec = 400
        assert _map(spark, values, V.plain_number) == [_plain(v) for v in values]


def test_errors_and_sizes(spark):
    long = "é" * 3000
    got = _map(spark, ["short", "x" * 5000, long], V.truncate_error)
    assert got[0] == "short" and len(got[1]) == 4096 and got[1].endswith("...[truncated]")
    assert len(got[2].encode()) <= 4096 and got[2].startswith("é" * 2000) and "�" not in got[2]
    assert _map(spark, ["512", "1536", "3221225472"], lambda c: V.human_bytes(c.cast("long"))) == ["512 B", "1.50 KB", "3.00 GB"]


def test_sizes_up_to_a_largest_unit_and_rounded_exactly(spark):
    units = [1 << 10 * i for i in range(6)]
    sizes = [1023, 1024, 1152, 1664, 2048 * units[3] + 5, 3 * units[4], 7 * units[5]] + [u * 1024 - 1 for u in units] + [(k * units[3] - 25) // 200 for k in (268435457 * 3, 1234567891)]
    near = [j for k in range(2 * 10**8 + 1, 2 * 10**8 + 20001, 2) for j in (k * units[3] // 200, k * units[3] // 200 + 1)]  # as near as can be to halves of a hundredth
    for largest in ("GB", "PB"):
        names = ["B", "KB", "MB", "GB", "TB", "PB"][: 4 if largest == "GB" else 6]
        power = lambda n: max(i for i in range(len(names)) if i == 0 or n >= units[i])  # noqa: E731, B023
        want = [f"{n} B" if not power(n) else f"{n / units[power(n)]:.2f} {names[power(n)]}" for n in sizes + near]
        assert _map(spark, [str(n) for n in sizes + near], lambda c: V.human_bytes(c.cast("long"), largest)) == want  # noqa: B023


def test_truncated_errors_against_brute_force(spark):
    def plain(text):
        body = text.encode()
        return text if len(body) <= 4096 else body[:4082].decode(errors="ignore") + "...[truncated]"

    texts = [lead + c * 5000 for c in ("x", "é", "語", "😀", "\ufffd", "a語é😀") for lead in ("", "a", "ab", "abc")] + ["é" * 2048, "é" * 2048 + "x", "x" * 4081 + "😀" * 9]
    assert _map(spark, texts, V.truncate_error) == [plain(x) for x in texts]


def test_truncated_errors_of_all_documents(spark, sf_dir):
    rows = QUERIES["x12_truncate_error"](spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs) and any(len(x) > 4096 and not x.isascii() for x in docs.values())
    for r in rows:
        body = docs[r["doc_id"]]
        assert r["error"] == (body.decode() if len(body) <= 4096 else body[:4082].decode(errors="ignore") + "...[truncated]")


def test_backoff(spark):
    got = _map(spark, ["1", "2", "5", "20"], lambda c: V.backoff_seconds(c.cast("int")))
    assert got == [2.0, 4.0, 32.0, 300.0]
    spread = _map(spark, ["1", "2", "5", "20"], lambda c: V.backoff_seconds(c.cast("int"), jitter=0.25, key=c))
    assert all(0.75 * a <= b <= 1.25 * a for a, b in zip(got, spread)) and spread != got


def test_tokens(spark):
    when = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    row = spark.createDataFrame([(5, when)], "size long, mtime timestamp").select(P.version_token("size", "mtime").alias("t")).first()
    assert row["t"] == "5-1704164645678901"
    assert _map(spark, [" a \r\n"], V.line_hash) == ["ca978112ca1bbdca"]


@pytest.mark.parametrize("status,verb,category,again", [(429, "POST", "rate_limited", True), (503, "POST", "server", False), (503, "get", "server", True), (404, "GET", "not_found", False)])
def test_outcomes(spark, status, verb, category, again):
    row = spark.createDataFrame([(status, verb)], "s int, v string").select(V.http_category("s").alias("c"), V.retryable("s", "v").alias("r")).first()
    assert (row["c"], row["r"]) == (category, again)
