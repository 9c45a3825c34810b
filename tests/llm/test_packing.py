import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from syncplan.llm.packing import op1_pack, pack
from syncplan.llm.tokens import Encoder, default_path

ODD = ["", None, " ", "a  b", "x \n y\n\n z", "\tab\x1c c\x85d  ", "don't 's  it's", "  lead", "trail \n", "é ́x Á", "ΑΣ ΣΑΣ",
       "!\x1c!  \x1c a\x00 b", "日本 語　x  1 22 333 a1b2", "<|endoftext|> a", "x" * 5000, "\xad soft\xad", "ß İ ǅ œ"]
SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|>  y\n", "<|ENDOFTEXT|> É", "<|endoftext| >"]


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_cached_ids_equal_the_library(name, drops):
    ours, plain = Encoder(default_path(name), drops, keep=10), Tokenizer.from_file(default_path(name))
    plain.encode_special_tokens = True
    for text in ODD:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def _holds(rows, docs):
    plain = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    used = padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 2048
        used += at
        padded += at if at & (at - 1) == 0 else 2048
    for doc, text in docs:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    return used, padded


def test_odd_texts(spark):
    docs = list(enumerate(ODD))
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string"), default_path("byte_bpe_50k.json")).collect()
    _holds(rows, docs)


def test_whole_table_with_little_padding(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, padded = _holds(op1_pack(spark, sf_dir).collect(), docs)
    assert padded < 1.05 * used


def test_step_groups_are_equal(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack(docs.coalesce(1), default_path("byte_bpe_50k.json"), step_tokens=4096).collect()
    tiers = {r["sequence_id"]: (r["step_group"], r["tier"]) for r in rows}
    groups = defaultdict(int)
    for group, tier in tiers.values():
        groups[group] += tier
    assert max(groups.values()) == 4096
    assert sorted(groups.values())[len(groups) // 4] > 3000


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, sequence_id string, offset int, tier string")
    assert pack(empty, default_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_added_tokens_equal_the_unmodified_library(name, drops):
    ours, plain = Encoder(default_path(name), drops, keep=10, added_tokens=True), Tokenizer.from_file(default_path(name))
    for text in [*ODD, *SPECIAL]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_query_gives_added_tokens_their_ids(spark, tmp_path):
    spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    rows = op1_pack(spark, str(tmp_path)).collect()
    for doc, text in enumerate(SPECIAL):
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) == len(ids) and {r["doc_tokens"] for r in own} == {len(ids)}
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]


def test_nothing_is_padded_and_odd_rows(spark):
    """Null ids, repeated rows and columns named as those of the result."""
    rows = [(None, "a b c", "x", 1), (4, "d e f g h i", "y", 2), (4, "d e f g h i", "y", 2), (None, None, "z", 3)] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, tier int").repartition(2)
    out = pack(df, default_path("byte_bpe_50k.json")).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r["sequence_id"]] += r["length"]
        assert r["tier"] == r["sequence_tokens"]
    assert all(n & (n - 1) == 0 for n in sizes.values())
    plain = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    assert sum(sizes.values()) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _, _ in rows)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="drops_space"):
        Encoder(default_path("word_bpe_49k.json"), False)
