import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from syncplan.llm.decontaminate import brute_force as contaminated
from syncplan.llm.quality_rules import measure
from syncplan.llm.secret_scan import RULES
from syncplan.llm.tokens import default_path


def _plain(docs, items, min_docs=20, max_share=0.05):
    """doc_id -> text after the first four stages, step by step on lists."""
    lines = {}
    for _, text, host in docs:
        for line in {" ".join(x.split()).lower() for x in text.split("\n")} - {""}:
            lines.setdefault((host, line), set()).add(text)
    texts = {}
    for _, text, host in docs:
        texts.setdefault(host, set()).add(text)
    often = {k for k, held in lines.items() if len(held) > max(min_docs, max_share * len(texts[k[0]]))}
    kept = {}
    for doc, text, host in docs:
        n, _, _, _, repeat, _ = measure(text)
        gone = [x for x in text.split("\n") if (host, " ".join(x.split()).lower()) in often]
        if n >= 50 and 100 * repeat <= 50 * n and 100 * sum(len(x.split()) for x in gone) <= 50 * n:
            kept[doc] = "\n".join(x for x in text.split("\n") if x not in gone)
    sets = {}
    for doc, text in kept.items():
        w = text.lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    label = {d: d for d in kept}
    changed = True
    while changed:
        changed = False
        for a in kept:
            for b in kept:
                if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    kept = {d: t for d, t in kept.items() if label[d] == d}
    kept = {d: t for (d, t), row in zip(kept.items(), contaminated(list(kept.items()), items), strict=True) if not row[-1]}
    for doc, text in kept.items():
        spans = sorted(m.span() for r in RULES for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least)
        merged = []
        for s, e in spans:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in reversed(merged):
            kept[doc] = kept[doc][:s] + "[secret]" + kept[doc][e:]
    return kept


def test_against_a_plain_version(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([6, 12, 30])))) for i in range(8)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.choice([20, 60, 150]))
        if rng.random() < 0.1:
            words = words[:10] * 10
        if rng.random() < 0.15:
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(items)[1].split()
        if rng.random() < 0.2:
            words.insert(rng.randrange(len(words)), "token=" + "Ab3" * 8)
        text = " ".join(words)
        if rng.random() < 0.5:
            text = "The same first line of this host.\n" + text
        docs.append([i, text, f"src{i % 2}"])
    for i in range(120, 160):
        base = rng.choice(docs[:120])[1].split(" ")
        base[rng.randrange(len(base))] = "changed"
        docs.append([i, " ".join(base), f"src{i % 2}"])
    spark.createDataFrame([(d, t, "en", h, len(t)) for d, t, h in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = _plain(docs, items)
    assert 10 < len(want) < 110 and sum("[secret]" in t for t in want.values()) > 3
    plain = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    for doc, text in want.items():
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [1], "<u4").tobytes()
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"] == len(ids) // 4
        assert all(r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in own)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_packing_gives_added_tokens_their_ids(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    ids = np.array([64, 220, 50256, 275, 1], "<u4")
    rows = sorted(corpus_pipeline.STAGES[-1][1](spark, docs, "").collect(), key=lambda r: r["start"])
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in rows] == [(0, 4, 5), (4, 1, 5)]  # powers of two, so nothing is padded
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(ids[:4].tobytes()), zlib.crc32(ids[4:].tobytes())]


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in any column, repeated rows, unlike texts under one id, a very long text, columns named as those within."""
    own = lambda seed, n=70: " ".join(f"w{seed}x{j}" for j in range(n))
    rows = [
        (1, own(1), "en", "h", 9, 111, "u", "s", [1], 5), (1, own(1), "en", "h", 9, 111, "u", "s", [1], 5),
        (1, own(2), None, None, None, None, None, None, None, None),
        (None, own(3), "en", "h", 9, 112, "u", "s", [2], 6), (None, own(3), "en", "h", 9, 112, "u", "s", [2], 6),
        (4, None, "en", "h", None, 1, "u", "s", [3], 7), (5, "", "en", "h", 0, 1, "u", "s", [3], 7),
        (6, own(6, 120_000) + " password = abcdefghijklmnop", "en", "h", 9, 1, "u", "s", [3], 7),
        (7, own(7) + " " + own("b", 12), "en", "h", 9, 1, "u", "s", [3], 7),
    ]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, k1 int, k2 string, spans string, removed_lines array<int>, label int"
    docs = spark.createDataFrame(rows, kinds)
    items = spark.createDataFrame([(1, own("b", 12)), (2, None), (None, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    got = sorted((tuple(r) for r in docs.collect()), key=lambda r: str(r[:1]) + r[1][:20])
    masked = own(6, 120_000) + " [secret]"
    want = [rows[0], rows[2], rows[3], (6, masked, "en", "h", len(masked), *rows[7][5:])]
    assert got == sorted(want, key=lambda r: str(r[:1]) + r[1][:20])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {1, None, 6}
    assert sum(r["start"] == 0 for r in pieces) == 4
