"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item gives windows of ``window`` consecutive words (an item of fewer words is one window).  A window is
the ordered set of its shingles of ``shingle`` words.  Shingles are ordered by rarity (the number of documents that
hold them, over all documents); as a window must be held whole, the prefix of length one is enough: its rarest
shingle, the key.  A document's shingles are joined with the keys; the key's place in the window gives the place
where the window would begin (positional bound), which must leave room for the whole window in the document (length
bound); the words there are then compared with the window's, byte by byte.

The benchmark side is broadcast in blocks of at most ``block_words`` words, a fixed bound: a larger benchmark takes
more passes over the documents, whose results are merged for each document.

Nulls and odd input: a null text has no words; an item whose text is null or has no words has no windows; a null
item_id is left out of item lists but its windows count as hits.  Repeated rows each get a row of the result.  Empty
tables give empty results or no hits.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import positional, read_table, row_key, stored
from .words import ALNUM, shingles, slices, words_of

#: Words of benchmark text that are broadcast at once (about 100 MB in a worker at most).
BLOCK_WORDS = 500_000


def _benchmark_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = words_of(batch.column(1), ALNUM)
        counts = words.counts()
        raw = words.data.tobytes()
        lists: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
        for r, s, e in zip(words.row.tolist(), words.start.tolist(), words.end.tolist(), strict=True):
            lists[r].append(raw[s:e])
        joined = pa.array([b" ".join(x) for x in lists], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), joined], ["item", "n", "words"])


class Block:
    """Windows of some items and, once shingles have their counts, the key shingle of each window.

    ``windows``: words joined by a space -> items that hold the window.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        self.windows: dict[bytes, set[int | None]] = defaultdict(set)
        for item, joined in items:
            own = joined.split(b" ")
            for i in range(max(1, len(own) - window + 1)):
                self.windows[b" ".join(own[i : i + window])].add(item)
        texts = list(self.windows)
        self.sizes = np.array([x.count(b" ") + 1 for x in texts])
        words = words_of(pa.array([x.decode("utf-8") for x in texts], pa.large_string()), ALNUM)
        #: for each length below a whole shingle, and the shingle's own: (window, place, hash)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        begin = np.searchsorted(words.row, np.arange(len(texts)))
        for k in sorted({min(shingle, int(n)) for n in self.sizes}):
            row, first, value = shingles(words, k, short=False)
            own = np.minimum(self.sizes[row], shingle) == k
            self.parts[k] = row[own], (first - begin[row])[own], value[own]
        self.texts = texts

    def known(self) -> dict[int, np.ndarray]:
        return {k: np.unique(value) for k, (_, _, value) in self.parts.items()}

    def choose(self, counts: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of shingle: keys in ascending order, their window and the key's place in it."""
        out = {}
        for k, (row, place, value) in self.parts.items():
            df = np.array([counts.get(x, 0) for x in value.astype(np.int64).tolist()])
            order = np.lexsort((place, value, df, row))  # rarest shingle of each window first
            first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
            held = first[df[first] > 0]  # a key that no document holds proves that its window occurs nowhere
            held = held[np.argsort(value[held], kind="stable")]
            out[k] = value[held], row[held], place[held]
        return out


def _count_shingles(known: dict[int, np.ndarray]):
    """Documents of each partition that hold each known shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(0), ALNUM)
                for k, keys in known.items():
                    row, _, value = shingles(words, k, short=False)
                    at, hit = _find(keys, value)
                    pairs = np.unique(row[hit].astype(np.int64) * len(keys) + at[hit])
                    found[k] += np.bincount(pairs % len(keys), minlength=len(keys)) if len(keys) else 0
        for k, keys in known.items():
            some = found[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].astype(np.int64)), pa.array(found[k][some])], ["shingle", "docs"])

    return run


def _find(keys: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value in the ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    at = np.searchsorted(keys, value)
    at[at == len(keys)] = 0
    return at, keys[at] == value


#: One row for each document and block: spans of hit words (begin, end) and the items held.
FOUND = T.StructType(
    [
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)


def _search(block: Block, keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    texts, sizes = block.texts, block.sizes
    items = [sorted(x for x in block.windows[t] if x is not None) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(3), ALNUM)
                counts = words.counts()
                begin = np.searchsorted(words.row, np.arange(part.num_rows))
                raw = words.data.tobytes()
                spans: list[list] = [[] for _ in range(part.num_rows)]
                held: list[set[int]] = [set() for _ in range(part.num_rows)]
                for k, (key, window, place) in keys.items():
                    row, first, value = shingles(words, k, short=False)
                    low = np.searchsorted(key, value, side="left")
                    high = np.searchsorted(key, value, side="right")
                    for i in np.flatnonzero(high > low).tolist():
                        r = int(row[i])
                        for j in range(int(low[i]), int(high[i])):
                            w = int(window[j])
                            at = int(first[i]) - int(place[j])  # positional bound: the window must begin here
                            if at < begin[r] or at + sizes[w] > begin[r] + counts[r]:  # length bound
                                continue
                            ends = range(at, at + int(sizes[w]))
                            if b" ".join(raw[words.start[x] : words.end[x]] for x in ends) == texts[w]:
                                spans[r].append([at - int(begin[r]), at - int(begin[r]) + int(sizes[w])])
                                held[r].update(items[w])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array(counts, pa.int64()),
                        pa.array([_joined(x) for x in spans], pa.list_(pa.list_(pa.int64()))),
                        pa.array([sorted(x) for x in held], pa.list_(pa.int64())),
                    ],
                    names=["k1", "k2", "doc_id", "n_words", "spans", "items"],
                )

    return run


def _joined(spans: list[list[int]]) -> list[list[int]]:
    """Union of spans of words, ascending."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> list[list[tuple[int | None, bytes]]]:
    """Items in blocks of at most so many words (or one item).  Each block is fetched alone, so none is larger."""
    words = benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).mapInArrow(
        _benchmark_words, "item long, n long, words binary"
    )
    block: list[tuple[int | None, bytes]] = []
    size = 0
    for row in words.filter("n > 0").toLocalIterator():
        if block and size + row["n"] > block_words:
            yield block
            block, size = [], 0
        block.append((row["item"], bytes(row["words"])))
        size += row["n"]
    if block:
        yield block


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``k1, k2`` (row key), ``doc_id, n_words, n_hit, items`` (ascending), ``spans`` of hit words, ``contaminated``."""
    docs, (doc_id, text) = positional(docs, doc_id, text)
    slim = docs.select(
        *row_key(doc_id, text), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    only_text = slim.select("text")
    passes: list[DataFrame] = []
    for items in _blocks(benchmark, item_id, item_text, block_words):
        block = Block(items, window, min(shingle, window))
        counts = only_text.mapInArrow(_count_shingles(block.known()), "shingle long, docs long")
        rows = counts.groupBy("shingle").agg(F.sum("docs").alias("docs")).collect()  # at most the block's own shingles
        keys = block.choose({r["shingle"]: r["docs"] for r in rows})
        passes.append(slim.mapInArrow(_search(block, keys), FOUND))
    if not passes:
        passes = [slim.mapInArrow(_search(Block([], window, shingle), {}), FOUND)]
    found = passes[0]
    if len(passes) > 1:
        first = stored(passes[0])
        more = stored(_union([p.filter("size(spans) > 0").select("k1", "k2", "spans", "items") for p in passes[1:]]))
        merged = (  # repeated rows give the same spans and items again, which the unions below take once
            more.groupBy("k1", "k2")
            .agg(
                F.array_distinct(F.flatten(F.collect_list("spans"))).alias("more_spans"),
                F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"),
            )
        )
        found = (
            first.join(merged, ["k1", "k2"], "left")
            .withColumn("spans", F.concat("spans", F.coalesce("more_spans", F.array().cast("array<array<bigint>>"))))
            .withColumn("items", F.array_sort(F.array_union("items", F.coalesce("more_items", F.array().cast("array<bigint>")))))
            .drop("more_spans", "more_items")
        )
        found = found.withColumn("spans", _merge_spans("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x[1] - x[0])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", F.col("n_hit") > 0)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _merge_spans(spans: str):
    """Union of sorted spans: each keeps only what reaches beyond all before it."""
    kind = "struct<done:array<array<bigint>>,end:bigint>"
    start = F.struct(F.array().cast("array<array<bigint>>").alias("done"), F.lit(0).cast("long").alias("end")).cast(kind)
    return F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, x: F.when(
            x[1] > acc["end"],
            F.struct(
                F.concat(acc["done"], F.array(F.array(F.greatest(x[0], acc["end"]), x[1]))).alias("done"), x[1].alias("end")
            ).cast(kind),
        ).otherwise(acc),
        lambda acc: acc["done"],
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no window of any item, in the columns of ``docs``.

    Columns of any name come through as they are; rows with equal id and text stay or go together.
    """
    plain, (key, body) = positional(docs, doc_id, text)
    bad = stored(decontaminate(plain, benchmark, key, body, **options).filter("contaminated").select("k1", "k2").dropDuplicates())
    keyed = plain.withColumns(dict(zip(("k1", "k2"), row_key(key, body), strict=True)))
    return keyed.join(bad, ["k1", "k2"], "left_anti").select(*plain.columns).toDF(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        "contaminated",
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 10) -> list[tuple]:
    """Rows of the query for a small input, straight from its definition; for tests."""
    import re

    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    upper = {c: c + 32 for c in range(65, 91)}
    out = []
    for doc_id, text in docs:
        words = split.findall((text or "").translate(upper))
        hit, held = set(), set()
        for item, item_text in items:
            own = split.findall((item_text or "").translate(upper))
            for i in range(max(1, len(own) - window + 1) if own else 0):
                w = own[i : i + window]
                for j in range(len(words) - len(w) + 1):
                    if words[j : j + len(w)] == w:
                        hit.update(range(j, j + len(w)))
                        held.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, held))).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(held), digest, bool(hit)))
    return out


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
),
win AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)
),
ks AS (SELECT DISTINCT k FROM win),
dw AS (
  SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)
),
occ AS (SELECT rid, i, dw.k AS k, item_id FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
hit AS (
  SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS w FROM (SELECT DISTINCT rid, i, k FROM occ))
  GROUP BY rid
),
it AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY rid
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
