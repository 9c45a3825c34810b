import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from syncplan.llm.mixing import cycled_weights, mix, op12_mixing, repeated, water_fill

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def levelled(sizes, weights, share=Fraction(3, 2), epochs=2):
    """Targets by clamping one round after another."""
    target, left, open_ = {}, share * sum(sizes.values()), {k for k in sizes if weights[k]}
    target |= {k: Fraction(0) for k in sizes if not weights[k]}
    while open_:
        total = sum(weights[k] for k in open_)
        above = {k for k in open_ if left * weights[k] / total >= epochs * sizes[k]}
        if not above:
            return target | {k: left * weights[k] / total for k in open_}
        target |= {k: Fraction(epochs * sizes[k]) for k in above}
        left -= sum(epochs * sizes[k] for k in above)
        open_ -= above
    return target


@pytest.mark.parametrize(
    "sizes, weights",
    [
        ({"a": 100, "b": 10, "c": 1000}, {"a": 5, "b": 2, "c": 1}),
        ({"a": 1, "b": 10, "c": 100, "d": 1000, "e": 0}, {"a": 5, "b": 5, "c": 5, "d": 5, "e": 1}),
        ({"a": 7}, {"a": 3}),
        ({"a": 0, "b": 0}, {"a": 1, "b": 2}),
        ({"a": 10, "b": 10}, {"a": 0, "b": 1}),
        ({"a": 10**15, "b": 10**15 + 7, "c": 3}, {"a": 999_983, "b": 1, "c": 1}),
        ({chr(97 + i): 2**i for i in range(20)}, {chr(97 + i): 1 for i in range(20)}),
    ],
)
def test_levels(spark, sizes, weights):
    rows = spark.createDataFrame([(k, sizes[k], weights[k]) for k in sizes], "key string, size long, weight long")
    expected = levelled(sizes, weights)
    for r in water_fill(rows).collect():
        assert r["target"] == pytest.approx(float(expected[r["key"]]), rel=1e-14)
        assert r["words"] == (2 * expected[r["key"]] + 1) // 2


def test_no_sources(spark):
    assert water_fill(spark.createDataFrame([], "key string, size long, weight long")).count() == 0


def _taken(docs):
    """Words taken of each (id, source, size), by sorting each source by hash."""
    sizes = defaultdict(int)
    for _, source, n in docs:
        sizes[source] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = levelled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    out = {}
    for source in names:
        words = int((2 * targets[source] + 1) // 2)
        whole, rest = divmod(words, sizes[source]) if sizes[source] else (0, 0)
        groups = defaultdict(int)
        for i, s, n in docs:
            if s == source:
                groups[i] += n
        for i in sorted(groups, key=lambda i: hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:16]):
            got = min(rest, groups[i])
            rest -= got
            for j, s, n in docs:
                if s == source and j == i:
                    out[i, source, n] = whole * n + (n * got // groups[i] if groups[i] else 0)
    return out


def test_odd_rows_and_columns_of_any_name(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    docs = [(i, "hot", words(i % 9)) for i in range(300)] + [(1000 + i, f"s{i % 5}", words(i)) for i in range(40)]
    docs += [(None, None, words(50)), (None, None, words(7)), (7, None, None), (8, "", " \n\t "), (9, "", ""), (10, "one", words(5000))]
    docs += [(11, "same", words(11))] * 20 + [(12, "same", "a  b c\x0bd")] * 3
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, source string, text string, mix int, `a.b` int, `K``` int")
    out = mix(df, cycled_weights(df))
    assert out.columns == [*df.columns, "mix_"]
    rows = out.collect()
    expected = _taken([(i, s, len(WORD.findall(t or ""))) for i, s, t in docs])
    assert len(rows) == len(docs)
    for r in rows:
        m = r["mix_"]
        assert m["size"] == len(WORD.findall(r["text"] or ""))
        assert m["repeats"] * m["size"] + m["part_words"] == expected[r["doc_id"], r["source"], m["size"]]
    assert mix(df.limit(0), cycled_weights(df)).count() == 0
    took = defaultdict(int)
    for r in repeated(out, mix="mix_").collect():
        took[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in rows:
        n = sum(x["source"] == r["source"] and x["doc_id"] == r["doc_id"] for x in rows)
        assert abs(took[r["source"]] - r["mix_"]["target"]) <= 0.5 + n  # rows of one id each lose less than a word


def test_a_repetition_in_part_is_the_texts_beginning(spark):
    df = spark.createDataFrame([(1, "a", " one  two\tthree\nfour ")], "doc_id long, source string, text string")
    out = repeated(mix(df, cycled_weights(df)))
    got = {r["repetition"]: r["text"] for r in out.collect()}
    assert got == {1: " one  two\tthree\nfour ", 2: " one  two"}


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "a", "x y", "other")], "doc_id long, source string, text string, TEXT string")
    assert mix(df, spark.createDataFrame([("a", 1)], "source string, weight int")).columns == [*df.columns, "mix"]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text").collect()
    expected = _taken([(d["doc_id"], d["source"], len(WORD.findall(d["text"] or ""))) for d in docs])
    rows = op12_mixing(spark, sf_dir).collect()
    source = {d["doc_id"]: d["source"] for d in docs}
    assert {(r["doc_id"], source[r["doc_id"]], r["size"]): r["taken"] for r in rows} == expected
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    again = op12_mixing(spark, sf_dir)
    assert again.exceptAll(spark.createDataFrame(rows, again.schema)).count() == 0
    assert abs(sum(r["taken"] for r in rows) - again.agg(F.sum("size")).first()[0] * 1.5) < len(set(source.values()))
