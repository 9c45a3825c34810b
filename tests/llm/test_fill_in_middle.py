import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from syncplan.llm import fill_in_middle as fim
from syncplan.llm.fill_in_middle import PLAIN, Rates, fill_in_middle, op13_fill_in_middle, restore, restored, rotate, token_ends, transform

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(text, doc_id, rates=Rates()):
    """The contract, by concatenation."""
    text, tokens = text or "", TOKENS.findall(text or "")
    digest = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rates.transformed:
        return "plain", text, n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < rates.spm:
        return "spm", f"<S>{s}<P>{p}<M>{m}", n, len(p), len(m)
    return "psm", f"<P>{p}<S>{s}<M>{m}", n, len(p), len(m)


TEXTS = st.text(st.sampled_from("ab<PSM> \t\n\x0b\x85\xa0é漢😀"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.one_of(st.none(), st.integers(-5, 10**12)))
def test_as_the_contract_and_back(text, doc_id):
    rates = Rates(transformed=90, spm=50)
    got = transform(text, doc_id, rates)
    assert got == plainly(text, doc_id, rates)
    assert restored(got[1], got[0]) == text


@given(st.binary(max_size=40), st.data())
def test_rotation(body, data):
    i, j, k = sorted(data.draw(st.tuples(*[st.integers(0, len(body))] * 3)))
    buffer = np.frombuffer(bytearray(body), np.uint8)
    middle = rotate(buffer, i, j, k)
    assert buffer.tobytes() == body[:i] + body[j:k] + body[i:j] + body[k:]
    assert rotate(buffer, i, middle, k) == j and buffer.tobytes() == body


def test_reversals_in_blocks(monkeypatch):
    monkeypatch.setattr(fim, "_REVERSED", 3)
    body = bytes(range(100))
    for cut in (0, 1, 49, 50, 99, 100):
        buffer = np.frombuffer(bytearray(body), np.uint8)
        rotate(buffer, 0, cut, 100)
        assert buffer.tobytes() == body[cut:] + body[:cut]


@given(TEXTS)
def test_token_ends(text):
    ends = [m.end() for m in re.finditer(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text.encode())]
    assert token_ends(np.frombuffer(text.encode(), np.uint8)).tolist() == ends


def test_odd_rows_and_columns_of_any_name(spark):
    long = "wörd " * 300_000
    texts = [None, "", " \n ", "one", "has <M> within", long, "a b c d", "a b c d"]
    rows = [(None if i == 3 else i // 2, t, i, i + 1, None, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim int, `a.b` int, `Text_` int, restored string")
    made = fill_in_middle(docs, rates=Rates(transformed=100))
    assert made.columns == [*docs.columns, "fim_"]
    got = restore(made, "fim_")
    assert got.columns == [*docs.columns, "fim_", "restored_"]
    for r in got.collect():
        assert tuple(r["fim_"]) == plainly(r["text"], r["doc_id"], Rates(transformed=100))
        assert r["restored_"] == (r["text"] or "") and r["a.b"] == r["fim"] + 1
    assert {r["fim_"]["form"] for r in got.collect()} > {PLAIN}
    assert restore(fill_in_middle(docs.limit(0)), "fim_").count() == 0


def test_whole_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = op13_fill_in_middle(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        form, out, n, prefix, middle = plainly(docs[r["doc_id"]], r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == sha(out) and r["restored_sha256"] == sha(docs[r["doc_id"]] or "")
    shares = spark.createDataFrame(rows).groupBy("form").agg(F.count("*").alias("n")).collect()
    assert {r["form"] for r in shares} == {"plain", "psm", "spm"}
