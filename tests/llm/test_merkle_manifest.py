import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from syncplan.llm import merkle_manifest as mm
from syncplan.llm.merkle_manifest import folded, leaf_digest, op11_merkle_manifest, proof_digest, proofs, write_manifest
from syncplan.scratch import shared_dir


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def siblings(levels, pos):
    """(left, right) of each level."""
    out = []
    for nodes in levels[:-1]:
        begin = pos - pos % 8
        out.append(("".join(nodes[begin:pos]), "".join(nodes[pos + 1 : begin + 8])))
        pos //= 8
    return out


def plainly(rows):
    """(tree, order, leaf) -> root, and for each row in order (tree, order, leaf, subroot, proof)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    trees = [(k, list(g)) for k, g in groupby(rows, key=lambda r: r[0])]
    grown = [tree_of([r[2] for r in g]) for _, g in trees]
    top = tree_of([levels[-1][0] for levels in grown])
    out = []
    for i, ((k, g), levels) in enumerate(zip(trees, grown, strict=True)):
        out += [(k, r[1], r[2], levels[-1][0], siblings(levels, j) + siblings(top, i)) for j, r in enumerate(g)]
    return (top[-1][0] if trees else None), out


def _made(spark, rows, path, **more):
    df = spark.createDataFrame(rows, "lang string, doc_id long, digest string")
    return write_manifest(df, path, "digest", **more)


def _rows(sizes):
    return [(k, (i * 7919) % n, h(str(k), str(i))) for k, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("every", [3, 1, 2])
def test_all_proofs(spark, monkeypatch, every):
    monkeypatch.setattr(mm, "EVERY", every)
    rows = _rows({None: 1, "": 2, "a": 8, "b": 9, "c": 64, "d": 65, "e": 513, "é": 70, "zz": 600 if every > 1 else 3, "z": 1, "y": 1})
    root, expected = plainly(rows)
    made = _made(spark, rows, shared_dir(spark))
    assert made.root == root
    got = proofs(made).withColumn("folded", folded(F.col("digest"), F.col("proof"))).withColumn("sha", proof_digest(F.col("proof"))).collect()
    found = {(r["tree"], r["kept"]["doc_id"]): r for r in got}
    assert len(got) == len(found) == len(rows)
    for tree, i, digest, subroot, proof in expected:
        r = found["" if tree is None else f"={tree}", i]
        assert (r["digest"], r["subroot"], r["folded"]) == (digest, subroot, root)
        assert [tuple(s) for s in r["proof"]] == proof and r["sha"] == h(*(a + b for a, b in proof))


def test_wanted_leaves_only(spark):
    rows = _rows({"a": 1500, "b": 30})
    made = _made(spark, rows, shared_dir(spark))
    assert made.levels == (3, 6) and made.top_levels == (3,)
    wanted = made.leaves().filter("kept.doc_id in (3, 1499)")
    got = proofs(made, wanted).collect()
    assert sorted((r["tree"], r["kept"]["doc_id"]) for r in got) == [("=a", 3), ("=a", 1499), ("=b", 3)]
    proof = {(r["tree"][1:], r["kept"]["doc_id"]): [tuple(s) for s in r["proof"]] for r in got}
    assert all(proof[t, i] == p for t, i, _, _, p in plainly(rows)[1] if (t, i) in proof)
    # of the leaves of a, those of the first and the last subtree are read, and all of b
    assert mm._under(made.leaves(), wanted, 0).count() == 512 + 1500 % 512 + 30


def test_odd_rows(spark):
    same = h("same")
    rows = [(None, None, same)] * 3 + [("x", None, h("1")), ("x", 5, h("3")), ("x", 5, h("2")), ("x", 5, h("2"))] + [("y", 1, same)] * 100
    root, expected = plainly(rows)
    made = _made(spark, rows, shared_dir(spark), keep=("doc_id", "lang"))
    assert made.root == root
    got = proofs(made).withColumn("folded", folded(F.col("digest"), F.col("proof"))).collect()
    key = lambda t, i, d, s, p: str((t, i, d, s, p))
    assert sorted(key(r["kept"]["lang"], r["kept"]["doc_id"], r["digest"], r["subroot"], [tuple(s) for s in r["proof"]]) for r in got) == sorted(key(*e) for e in expected)
    assert {r["folded"] for r in got} == {root}
    wrong = proofs(made).select(folded(F.lit(h("forged")), F.col("proof")).alias("f")).distinct().collect()
    assert root not in {r["f"] for r in wrong}


def test_no_rows_and_columns_of_any_name(spark):
    made = _made(spark, [], shared_dir(spark))
    assert made.root is None and proofs(made).count() == 0
    df = spark.createDataFrame([("a", 1, h("1"), "u", 9), ("a", 2, h("2"), "v", 8)], "lang string, doc_id long, digest string, `tree.n` string, LANG int")
    made = write_manifest(df, shared_dir(spark), "digest", keep=("tree.n", "LANG"))
    got = proofs(made).orderBy("pos").collect()
    assert [tuple(r["kept"]) for r in got] == [("u", 9), ("v", 8)] and made.root == h(h("1"), h("2"))


def test_leaf_digests(spark):
    df = spark.createDataFrame([(1, "é", None), (None, "", "a:b")], "a long, b string, c string")
    got = [r[0] for r in df.select(leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [leaf(1, "é", None), leaf(None, "", "a:b")]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = lambda d, t: leaf(d["doc_id"], d["source"], d["lang"], d["n_chars"], t)
    root, expected = plainly([(d["lang"], d["doc_id"], digest(d, d["text"])) for d in docs])
    rows = {r["doc_id"]: r for r in op11_merkle_manifest(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    by_id = {d["doc_id"]: d for d in docs}
    for _, i, own, subroot, proof in expected:
        d, r = by_id[i], rows[i]
        text = d["text"].translate(lower) if d["text"] is not None and zlib.crc32(str(i).encode()) % 3 == 0 else d["text"]
        node = digest(d, text)
        for a, b in proof:
            node = h(a, node, b)
        assert (r["leaf"], r["subroot"], r["root"]) == (own, subroot, root)
        assert (r["proof_sha256"], r["folded_root"], r["verified"]) == (h(*(a + b for a, b in proof)), node, node == root)
    assert 0 < sum(not r["verified"] for r in rows.values()) < len(rows)
