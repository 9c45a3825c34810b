import random
import re
import string

import duckdb

from syncplan.llm.secret_scan import ANY, OP4_SQL, RULES, brute_force, mask_secrets, op4_secret_scan, secret_spans, trigram_query


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert _rows(got) == sorted((brute_force(r["doc_id"], r["text"]) for r in docs), key=str)


def test_queries():
    assert trigram_query("[0-9a-f]+") == ANY
    assert trigram_query("AKIA[A-Z0-9]+") == frozenset([frozenset({"aki", "kia"})])
    assert trigram_query("(?:abcd|xyz)e?f") == frozenset([frozenset(x) for x in (
        {"abc", "bcd", "cde", "def"}, {"abc", "bcd", "cdf"}, {"xyz", "yze", "zef"}, {"xyz", "yzf"})])
    assert trigram_query("ab*cde") == frozenset([frozenset({"cde"})])
    assert trigram_query("x{2,}abc") == frozenset([frozenset({"abc"})])
    assert trigram_query("(abc)?") == ANY


def test_queries_hold_for_every_match():
    rng = random.Random(1)
    samples = ["password = 'hunter2hunter2'", 'API_KEY:"abcDEF123456789"', "apikey=aaaaaaaaaaaa", "AKIA" + "Z9" * 8,
               "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-1234567890-ab",
               "AIza" + "b" * 35, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM", "sk_live_" + "0" * 16]
    for _ in range(300):
        text = "".join(rng.choices(string.printable, k=20)).join(rng.choices(samples, k=3))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for rule in RULES:
            if re.search(rule.pattern, text):
                assert any(all(t in low for t in need) for need in trigram_query(rule.pattern))


def test_odd_rows(spark):
    texts = [None, "", "token=short", "é token: abcdefghijkl é", "ToKeN='ABCDEFGHIJKL', secret=aaaaaaaaaaaaaaaaaaaa", "toKen=abcdefghijkl",
             "AKIA" * 9, "deadbeef" * 9000, "x" * 70000 + "passwd=" + "q" * 30, "token=token=tokentokentoken"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, texts[3], "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r["doc_id"], ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"])) for r in secret_spans(df, block_rows=2).na.fill(-1).collect())
    assert got == sorted((-1 if i is None else i, brute_force(i, t)[-1]) for i, t, _ in rows)
    assert secret_spans(df.limit(0)).count() == 0


def test_masking(spark):
    rows = [(1, "a token=abcdefghijklmnop b", 26), (2, "clean", 5), (3, None, None), (None, "x AKIA" + "B" * 14 + " y", 22)]
    got = _rows(mask_secrets(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")))
    assert got == sorted([(1, "a [secret] b", 12), (2, "clean", 5), (3, None, None), (None, "x [secret] y", 12)], key=str)


def test_masked_documents_keep_columns_of_any_name(spark):
    rows = [(1, "password = abcdefghijklmnop end", 5, "s", [1]), (None, None, 6, None, None), (2**60 + 1, "clean", 7, "t", [2]), (2**60 + 1, "clean", 7, "t", [2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 long, spans string, candidates array<int>")
    out = sorted((tuple(r) for r in mask_secrets(df).collect()), key=str)
    assert out == sorted([(1, "[secret] end", 5, "s", [1]), *rows[1:]], key=str)


def test_whole_table_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    rows = op4_secret_scan(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({OP4_SQL})").fetchall()
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)
