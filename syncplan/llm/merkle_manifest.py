"""Merkle dataset manifest by checkpoint and recompute.

Each row is a leaf: a digest of its columns.  The leaves of a tree (rows of one language, by ascending id) and then the
nodes of each level are hashed together in runs of eight until one node remains; the trees' roots make a tree of their own
whose root stands for the whole table.

Of the levels only every third is kept: the leaves, the roots of aligned subtrees of 512 leaves, of 512 of those, and so on.
A proof (the siblings on the way up) is made from the kept levels downwards: each aligned subtree is built again from its
stored descendants, every member gets its siblings at the three levels and the proof of the subtree's root behind them, and
the inner nodes are dropped.  Subtrees are bounded by 512 members and independent of each other, so there is no large
group, and only the subtrees of wanted leaves are built.

Nulls and odd input: nulls have a mark of their own in digests; a null tree or id comes first; rows of one id are ordered by
digest, and equal rows are leaves beside one another; an empty table has no trees and no root.  Kept columns stay in a
struct, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import null_first, positional, ranked, read_table, shared_dir

#: Nodes of a run (a power of two), and levels between two that are kept.
RUN, EVERY = 8, 3
PROOF = "array<struct<left: string, right: string>>"
_NODE = "tree string, n long, pos long, digest string"


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the columns' values: ``-`` for null, else the number of bytes in UTF-8, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings from the leaf's run to the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


@dataclass(frozen=True)
class Manifest:
    """A manifest's folder: ``leaves``, ``level=3``, ``level=6``, ... and the same of the tree of roots in ``top``."""

    spark: SparkSession
    path: str
    levels: tuple[int, ...]
    top_levels: tuple[int, ...]
    root: str | None

    def leaves(self) -> DataFrame:
        """``tree, n, pos, digest`` and a struct ``kept``; a tree is named ``=`` and its key, or nothing where that is null."""
        return self.spark.read.parquet(f"{self.path}/leaves")

    def nodes(self, level: int, top: str = "") -> DataFrame:
        return self.spark.read.schema(_NODE).parquet(f"{self.path}{top}/level={level}")


def _up(pos: Column, levels: int) -> Column:
    """Where the node is that stands so many levels above."""
    return F.shiftright(pos, levels * (RUN.bit_length() - 1))


def _runs(nodes: Column) -> Column:
    """Digests of the runs of an array of digests."""
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(RUN)), lambda i: F.sha2(F.array_join(F.slice(nodes, i, RUN), ""), 256))


def _subtrees(nodes: DataFrame, *kept: str) -> DataFrame:
    """Aligned subtrees: their ``members``, the digests of each level within (``level0`` up to ``height``), and their root.

    ``nodes`` are of trees of more than one node (``n``); ``height`` is less than EVERY where the tree ends before.
    """
    n = F.col("n")
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *kept)), lambda a, b: (a["pos"] - b["pos"]).cast("int"))
    out = nodes.groupBy("tree", "n", _up(F.col("pos"), EVERY).alias("subtree")).agg(members.alias("members"))
    out = out.withColumn("height", sum((F.when(n > RUN**k, 1).otherwise(0) for k in range(1, EVERY)), F.lit(1)))
    out = out.withColumn("level0", F.transform("members", lambda m: m["digest"]))
    for k in range(EVERY):
        out = out.withColumn(f"level{k + 1}", F.when(F.col("height") > k, _runs(F.col(f"level{k}"))))
    root = F.coalesce(*(F.col(f"level{k}") for k in range(EVERY, 0, -1)))[0]
    return out.withColumn("root", root)


def _grow(nodes: DataFrame, path: str) -> tuple[int, ...]:
    """Writes every third level above the nodes and returns the levels; trees of one node are done."""
    spark, levels, level = nodes.sparkSession, [], 0
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level += EVERY
        up = F.when(F.col("n") > RUN**EVERY, F.ceil(F.col("n") / RUN**EVERY)).otherwise(1).cast("long")
        grown = _subtrees(nodes.filter("n > 1").select("tree", "n", "pos", "digest"))
        grown.select("tree", up.alias("n"), F.col("subtree").alias("pos"), F.col("root").alias("digest")).write.parquet(f"{path}/level={level}")
        nodes = spark.read.schema(_NODE).parquet(f"{path}/level={level}")
        levels.append(level)
        most = -(-most // RUN**EVERY)
    return tuple(levels)


def write_manifest(rows: DataFrame, path: str, digest: str, tree: str = "lang", order: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> Manifest:
    """Writes the manifest of the leaves (column ``digest``) to a new folder; ``keep`` are columns to store beside them."""
    plain, (leaf, key, at, *own) = positional(rows, digest, tree, order, *keep)
    kept = F.struct(*(F.col(c).alias(name) for c, name in zip(own, keep, strict=True))).alias("kept")
    leaves = plain.select(null_first(key).alias("tree"), F.col(at).alias("at"), F.col(leaf).alias("digest"), kept)
    leaves = ranked(leaves, ["tree"], ["at", "digest"], "pos", "n")
    leaves.select("tree", "n", "pos", "digest", "kept").write.parquet(f"{path}/leaves")
    manifest = Manifest(rows.sparkSession, path, (), (), None)
    levels = _grow(manifest.leaves(), path)
    roots = manifest.leaves().filter("n = 1").select("tree", "digest")
    for level in levels:
        roots = roots.unionByName(manifest.nodes(level).filter("n = 1").select("tree", "digest"))
    top = ranked(roots.withColumn("whole", F.lit("")), ["whole"], ["tree"], "pos", "n")
    top.select(F.col("whole").alias("tree"), "n", "pos", "digest", F.struct("tree").alias("kept")).write.parquet(f"{path}/top/leaves")
    top = rows.sparkSession.read.parquet(f"{path}/top/leaves")
    top_levels = _grow(top, f"{path}/top")
    last = manifest.nodes(top_levels[-1], "/top") if top_levels else top
    found = last.select("digest").head()
    return Manifest(rows.sparkSession, path, levels, top_levels, found[0] if found else None)


def _proofs(nodes: DataFrame, above: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """``tree, pos, digest, proof`` and ``kept`` of the members of all subtrees of ``nodes``; ``above`` has their roots' proofs.

    Columns of ``above`` beyond tree, pos and proof come along.
    """
    rest = [c for c in above.columns if c not in ("tree", "pos", "proof")]
    trees = _subtrees(nodes, *kept).join(above.withColumnRenamed("pos", "subtree"), ["tree", "subtree"])
    each = trees.withColumn("m", F.explode("members"))
    steps = []
    for k in range(EVERY):
        j = _up(F.col("m")["pos"] % RUN**EVERY, k).cast("int")
        begin, own = j - j % RUN, F.col(f"level{k}")
        left, right = F.slice(own, begin + 1, j % RUN), F.slice(own, j + 2, F.lit(RUN - 1) - j % RUN)
        steps.append(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
    proof = F.concat(F.slice(F.array(*steps), F.lit(1), F.col("height")), F.col("proof"))
    return each.select("tree", "m.pos", "m.digest", proof.alias("proof"), *rest, *(f"m.{c}" for c in kept))


def _under(nodes: DataFrame, wanted: DataFrame | None, level: int) -> DataFrame:
    """The nodes of subtrees (each EVERY levels above ``level``) that lead to wanted leaves."""
    if wanted is None:
        return nodes
    at = lambda k: _up(F.col("pos"), k).alias("subtree")
    return nodes.withColumn("subtree", at(EVERY)).join(wanted.select("tree", at(level + EVERY)).distinct(), ["tree", "subtree"], "left_semi").drop("subtree")


def _descend(manifest: Manifest, levels: tuple[int, ...], top: str, tops: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Proofs of all leaves below the trees' roots, whose own proofs ``tops`` has (tree, proof and what comes along)."""
    leaves = manifest.spark.read.parquet(f"{manifest.path}{top}/leaves")
    proofs = None
    for level in (*reversed(levels), 0):
        nodes = manifest.nodes(level, top) if level else leaves
        kept = () if level else ("kept",)
        done = _under(nodes.filter("n = 1"), wanted, level).join(tops, "tree").select("tree", "pos", "digest", "proof", *(c for c in tops.columns if c not in ("tree", "proof")), *kept)
        if proofs is not None:
            done = done.unionByName(_proofs(_under(nodes.filter("n > 1"), wanted, level), proofs.drop("digest"), kept))
        proofs = done
    return proofs if wanted is None else proofs.join(wanted.select("tree", "pos").distinct(), ["tree", "pos"], "left_semi")


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """``tree, pos, digest, subroot, proof, kept`` of all leaves, or of those that ``wanted`` names by tree and pos.

    ``proof`` (PROOF) has for each level the digests left and right of the node, strung together.
    """
    none = F.array().cast(PROOF).alias("proof")
    tops = _descend(manifest, manifest.top_levels, "/top", manifest.spark.createDataFrame([("",)], "tree string").select("tree", none))
    tops = tops.select(F.col("kept.tree").alias("tree"), "proof", F.col("digest").alias("subroot"))
    return _descend(manifest, manifest.levels, "", tops, wanted)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third id is presented with its text in lower case; the others as they are."""
    docs = read_table(spark, sf_dir, "documents")
    text, columns = F.col("text"), [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = leaf_digest(*columns, text)
    presented = F.when(tampered, leaf_digest(*columns, F.translate(text, letters, letters.lower()))).otherwise(leaf)
    rows = docs.select("doc_id", "lang", leaf.alias("leaf"), presented.alias("presented"))
    manifest = write_manifest(rows, shared_dir(spark), "leaf", keep=("doc_id", "presented"))
    found = folded(F.col("kept.presented"), F.col("proof"))
    out = proofs(manifest).select(
        "kept.doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"), found.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: For the rows of the query, level by level; ``crc`` is the CRC-32 of the decimal id, bit by bit.
OP11_SQL = r"""
WITH RECURSIVE e AS (SELECT *, CASE WHEN text IS NULL THEN '-' ELSE concat(CAST(strlen(text) AS VARCHAR), ':', text) END AS t,
  concat(coalesce(concat(CAST(strlen(CAST(doc_id AS VARCHAR)) AS VARCHAR), ':', CAST(doc_id AS VARCHAR)), '-'), coalesce(concat(CAST(strlen(source) AS VARCHAR), ':', source), '-'),
   coalesce(concat(CAST(strlen(lang) AS VARCHAR), ':', lang), '-'), coalesce(concat(CAST(strlen(CAST(n_chars AS VARCHAR)) AS VARCHAR), ':', CAST(n_chars AS VARCHAR)), '-')) AS head,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
   lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) AS crc FROM documents),
l AS (SELECT doc_id, lang, sha256(concat(head, t)) AS leaf, sha256(concat(head, CASE WHEN crc % 3 = 0 THEN translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE t END)) AS presented FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, coalesce('=' || lang, '') AS tree FROM l),
n AS (SELECT 0 AS level, tree, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
 UNION ALL SELECT level + 1, tree, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM n WHERE n > 1 GROUP BY level, tree, pos // 8, n),
r AS (SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n WHERE n.n = 1),
m AS (SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM r
 UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM m WHERE n > 1 GROUP BY level, pos // 8, n),
steps AS (SELECT p.tree, p.pos, n.level, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos < p.pos // (1 << (3 * n.level))), '') AS a,
  coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos > p.pos // (1 << (3 * n.level))), '') AS b
 FROM p JOIN n ON n.tree = p.tree AND n.n > 1 AND n.pos // 8 = p.pos // (8 << (3 * n.level)) GROUP BY p.tree, p.pos, n.level
 UNION ALL SELECT p.tree, p.pos, r.height + m.level, coalesce(string_agg(m.h, '' ORDER BY m.pos) FILTER (WHERE m.pos < r.pos // (1 << (3 * m.level))), ''),
  coalesce(string_agg(m.h, '' ORDER BY m.pos) FILTER (WHERE m.pos > r.pos // (1 << (3 * m.level))), '')
 FROM p JOIN r ON r.tree = p.tree JOIN m ON m.n > 1 AND m.pos // 8 = r.pos // (8 << (3 * m.level)) GROUP BY p.tree, p.pos, r.height, m.level),
f AS (SELECT tree, pos, 0 AS level, presented AS h FROM p
 UNION ALL SELECT f.tree, f.pos, f.level + 1, sha256(concat(s.a, f.h, s.b)) FROM f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.level = f.level)
SELECT p.doc_id, p.leaf, r.subroot, m.h AS root, sha256(coalesce((SELECT string_agg(s.a || s.b, '' ORDER BY s.level) FROM steps s WHERE s.tree = p.tree AND s.pos = p.pos), '')) AS proof_sha256,
 x.h AS folded_root, x.h = m.h AS verified
FROM p JOIN r ON r.tree = p.tree JOIN m ON m.n = 1 JOIN (SELECT tree, pos, arg_max(h, level) AS h FROM f GROUP BY tree, pos) x ON x.tree = p.tree AND x.pos = p.pos"""
