import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from syncplan.llm import token_files
from syncplan.llm.common import shared_dir
from syncplan.llm.token_files import decode_ranks, encode_ranks, op2_token_files, read_token_files, write_token_files
from syncplan.llm.tokens import Encoder, default_path


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_round_trip(values):
    control, data = encode_ranks(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    back = decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert back.tolist() == values


def _expected(docs):
    plain = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    out, start = [], 0
    for doc, text in sorted(docs, key=lambda x: x[0]):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op2_token_files(spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == _expected(docs)


def test_nulls_repeats_and_many_files(spark, monkeypatch):
    monkeypatch.setattr("syncplan.llm.token_files.FILE_BYTES", 40)
    docs = [(3, "a b c"), (1, None), (2, ""), (2, "x y"), (9, "same"), (9, "same"), (None, "no id"), (-5, "Ünïcode ÉÈ")]
    path = shared_dir(spark)
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, path string")
    write_token_files(df, path, default_path("word_bpe_49k.json"))
    rows = [tuple(r) for r in read_token_files(spark, path).collect()]
    assert len(rows) == len(docs) and sum(r[2] for r in rows) == max(r[1] + r[2] for r in rows)
    rows.sort(key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, -5, 1, 2, 2, 3, 9, 9]
    assert {(r[0], r[2], r[3]) for r in rows if r[0] is not None} == {
        (d, n, c) for d, _, n, c in _expected([x for x in docs if x[0] is not None])
    }


def test_empty(spark):
    path = shared_dir(spark)
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, default_path("word_bpe_49k.json"))
    assert read_token_files(spark, path).count() == 0


def test_query_gives_added_tokens_their_ids(spark, tmp_path):
    docs = [(1, "a <|endoftext|> b"), (2, "c"), (3, "<|startoftext|>d <|ENDOFTEXT|>"), (4, "e")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain, want, start = Tokenizer.from_file(default_path("word_bpe_49k.json")), [], 0
    for doc, text in docs:
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op2_token_files(spark, str(tmp_path)).collect()) == want


def test_long_texts_null_ids_and_repeated_rows_over_several_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 4000)
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    rows = [(None, "no id", 1), (7, "word " * 60_000, 2), (3, None, 3), (3, "twice", 4), (3, "twice", 4), (5, "", 5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    path = shared_dir(spark)
    write_token_files(df, path, default_path("word_bpe_49k.json"), added_tokens=True)
    got = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    plain = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    want = []
    for doc, text, _ in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: -1 if d is None else d)


def test_files_go_by_number(spark):
    """Beyond 99,999 files names no longer sort as text."""
    names = [f"file:/x/ids/part-{n}-abc-c000.txt" for n in ("00007", "99999", "100000", "1000000")]
    df = spark.createDataFrame([(n,) for n in names[::-1]], "path string")
    assert [r[0] for r in df.orderBy(token_files.file_number()).collect()] == names


_ODD_CHARS = " \t\n\x0b\x0c\r\x00\x1c\x1f\x7f\x80\x85\x97\xa0\xad\xaa\xb5\xb2\xbd\xb7×÷ßÿÀÞàéÉÑİſ\u212a\u0301\u0344\u2019\u2014\u2028\u3000\u200b中Я٣😀"
_TEXTS = st.lists(
    st.sampled_from([*_ODD_CHARS, *"'smRLeva19.,($ ", "'s", "'LL", "'re", "don't", "Wörter ", "<|endoftext|>", "<|"]) | st.text(max_size=3), max_size=14
).map("".join)
_LIBRARY = Tokenizer.from_file(default_path("word_bpe_49k.json"))
_ENCODER = Encoder(default_path("word_bpe_49k.json"), True, added_tokens=True, kind="<u2")


@settings(deadline=None, max_examples=400)
@given(st.lists(st.none() | _TEXTS, max_size=5), st.integers(0, 2))
def test_many_texts_at_once_have_the_ids_of_the_library(texts, begin):
    got = _ENCODER.encode_all(pa.array(["før", *texts], pa.string())[begin:], 1).to_pylist()
    want = [[*_LIBRARY.encode(x or "", add_special_tokens=False).ids, 1] for x in ["før", *texts][begin:]]
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_each_different_piece_is_looked_up_once(monkeypatch):
    """Work of the slowest stage goes with different pieces, not with words."""
    asked = []
    run, kind = token_files._tokenize(default_path("word_bpe_49k.json"), 1, True, True)
    ids = Encoder(default_path("word_bpe_49k.json"), True, added_tokens=True, kind=kind)

    class Counted(type(ids.parts)):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    for name in ("parts", "uncut"):
        if hasattr(ids, name):
            kept = getattr(ids, name)
            setattr(ids, name, Counted(kept.make, kept.keep))
    monkeypatch.setattr(token_files, "encoder", lambda *_: ids)
    text = "The house's door, the Door. É5 " * 300
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text])], ["doc_id", "text"])
    (out,) = run(iter([batch]))
    assert [np.frombuffer(x, kind).tolist() for x in out.column(1).to_pylist()] == 2 * [[*_LIBRARY.encode(text, add_special_tokens=False).ids, 1]]
    assert sorted(asked) == sorted(["the", "house", "'s", "door", ",", ".", "é", "5"])
