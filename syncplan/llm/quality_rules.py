"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for each host the distinct documents (distinct texts) that hold a line are counted;
lines above the host's limit are removed; a document that loses most of its words is rejected, and so is one that
breaks the base rules.

Nulls and odd input: a null text has no words, so it fails the base rules; a null host is a host of its own.  Repeated
rows each get a row of the result and count once in line frequencies.  An empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache_of, positional, read_table, row_key, stored, with_length
from .words import slices

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " lines array<struct<line: long, words: long>>"
)


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total, covered = 0, 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def measure(text: str | None) -> tuple:
    """Counts of one text and, for each distinct normalised line that has a word, its hash and all its words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at exactly the six ASCII white-space characters
    seen: set[bytes] = set()
    lines: Counter[int] = Counter()
    repeated = 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        repeated += line in seen
        seen.add(line)
        digest = hashlib.blake2b(b" ".join(own).lower(), digest_size=8).digest()
        lines[int.from_bytes(digest, "little", signed=True)] += len(own)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, SYMBOLS)),
        repeated,
        _repeat_words(words),
        list(lines.items()),
    )


def _measure_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = [x.split()[0] for x in MEASURES.split(", lines")[0].split(",")]
    cache_of("rules")
    for whole in batches:
        for batch in slices(whole, "text"):
            found = [measure(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            lines = [x for row in found for x in row[-1]]
            offsets = np.cumsum([0, *(len(row[-1]) for row in found)])
            pairs = pa.StructArray.from_arrays([pa.array([x[i] for x in lines], pa.int64()) for i in (0, 1)], ["line", "words"])
            columns = [pa.array([row[i] for row in found], pa.int64()) for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                [*batch.schema.names[:-1], *counts, "lines"],
            )


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id, host, k1, k2`` (row key) and MEASURES for each row."""
    docs, (doc_id, text, host) = positional(docs, doc_id, text, host)
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        *row_key(doc_id, host, text),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
        F.col(text).cast("string").alias("text"),
    )
    return slim.mapInArrow(_measure_all, f"doc_id long, host string, k1 long, k2 long, text_key long, {MEASURES}")


def frequent_lines(rows: DataFrame, min_docs: int = 20, max_share: float = 0.05) -> DataFrame:
    """``host, line`` of the lines held by more distinct texts of the host than max(min_docs, max_share of them).

    Copies of one text count once, so a line isn't boilerplate only because its document was copied.  Counts are
    summed before the shuffle, so a line that most documents share doesn't load one task.
    """
    texts = rows.select("host", "text_key", "lines").dropDuplicates(["host", "text_key"])
    limits = texts.groupBy("host").agg(
        F.greatest(F.lit(float(min_docs)), F.count(F.lit(1)) * F.lit(float(max_share))).alias("limit")
    )
    counts = (
        texts.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    )
    counts = counts.filter(F.col("docs") > min_docs)
    return (
        counts.join(limits.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
        .filter("docs > limit")
        .select("host", "line", "docs")
    )


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_docs: int = 20,
    max_share: float = 0.05,
    max_removed_percent: int = 50,
) -> DataFrame:
    """One row for each row of ``docs``: measures, ``removed_words``, ``removed_lines`` (hashes) and verdicts."""
    rows = stored(measured(docs, doc_id, text, host))
    often = stored(frequent_lines(rows, min_docs, max_share))
    hits = (
        rows.select("host", "k1", "k2", F.explode("lines").alias("x"))
        .select(F.coalesce("host", F.lit("\x00null")).alias("h"), "k1", "k2", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
        .join(often.select(F.coalesce("host", F.lit("\x00null")).alias("h"), "line"), ["h", "line"])
        .groupBy("k1", "k2", "line")
        .agg(F.max("words").alias("words"))  # repeated rows give the same line once
        .groupBy("k1", "k2")
        .agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        rows.drop("lines", "text_key")
        .join(hits, ["k1", "k2"], "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("depleted", 100 * F.col("removed_words") > max_removed_percent * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def _without(text: str, removed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lists = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index(removed)).to_pylist()
            out = []
            for whole, gone in zip(batch.column(at).to_pylist(), map(set, lists), strict=True):
                left = []
                for line in whole.split("\n"):
                    own = line.encode("utf-8", "surrogatepass").split()
                    digest = hashlib.blake2b(b" ".join(own).lower(), digest_size=8).digest()
                    if not own or int.from_bytes(digest, "little", signed=True) not in gone:
                        left.append(line)
                out.append("\n".join(left))
            kept = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            yield kept.drop_columns([removed])

    return run


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **rules) -> DataFrame:
    """The documents that pass, without their removed lines, in the columns of ``docs``; ``n_chars`` follows the text.

    Columns of any name come through as they are; rows with equal id, host and text have one verdict.
    """
    plain, (key, body, at) = positional(docs, doc_id, text, host)
    verdict = quality_rules(plain, key, body, at, **rules).filter("kept").select("k1", "k2", "removed_lines").dropDuplicates(["k1", "k2"])
    kept = plain.withColumns(dict(zip(("k1", "k2"), row_key(key, at, body), strict=True))).join(verdict, ["k1", "k2"])
    whole, cut = kept.filter("removed_lines is null"), kept.filter("removed_lines is not null")
    cut = cut.select(*plain.columns, "removed_lines").mapInArrow(_without(body, "removed_lines"), plain.schema)
    return whole.select(*plain.columns).unionByName(with_length(cut, docs, body)).toDF(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP6_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
m AS (
  SELECT rid, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars FROM w
),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
ln AS (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM t),
lw AS (
  SELECT rid, host, text, line, len(own) AS words,
         translate(array_to_string(own, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS own FROM ln) WHERE len(own) > 0
),
d AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY rid),
lim AS (SELECT host, greatest(20.0, 0.05 * count(DISTINCT text)) AS lim FROM t GROUP BY host),
freq AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS c FROM lw GROUP BY host, norm) f
  JOIN lim USING (host) WHERE c > lim
),
rem AS (SELECT rid, sum(words) AS removed FROM lw JOIN freq USING (host, norm) GROUP BY rid)
SELECT t.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
       (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words)
         AND NOT (100 * coalesce(removed, 0) > 50 * n_words) AS kept
FROM t JOIN m USING (rid) LEFT JOIN d USING (rid) LEFT JOIN r USING (rid) LEFT JOIN rem USING (rid)
"""
