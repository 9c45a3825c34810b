"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the whole corpus (most frequent first), so common ids take one byte.  Four ranks
share a control byte that holds their lengths (one to four bytes, two bits each); data bytes follow one another apart
from the control bytes.  A reader looks lengths up in a table of 256 rows and decodes with numpy, with no loop over ids.

A file is a sequence of blocks, little-endian: ``TIDS``, number of documents, number of ids, bytes of control, bytes of
data (unsigned 32-bit each), doc ids (signed 64-bit), a byte for each document (1: its doc id is null), ids a document
(unsigned 32-bit), control bytes, data bytes, crc32 of all before it, and ``\\n``.  Files hold ascending ranges of doc
ids and their names ascend.  ``ranks`` beside them lists rank, id and count.

Nulls and odd input: a null text is empty and gives its end id alone; null doc ids come first; repeated rows are written
once each, next to each other; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .binary_files import read_files, write_blocks
from .common import positional, read_table, shared_dir, stored
from .tokens import default_path, encoder, no_cycle_search
from .words import slices

MAGIC = b"TIDS"
_HEAD = "<4s4I"
#: Ids of a block, and bytes of ids (four each) of a file before coding.
BLOCK_IDS = 1 << 19
FILE_BYTES = 48 << 20
#: Bytes of text that are tokenized together; each different piece in them is looked up once.
TEXT_BYTES = 8 << 20

_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes; the last control byte is filled up with ranks of length one that have no data."""
    wide = ranks.astype("<u4" if len(ranks) and ranks.max() > 0xFFFF else "<u2")
    extra = (wide > 0xFF).astype(np.uint8)
    if wide.itemsize > 2:
        extra += (wide > 0xFFFF).astype(np.uint8) + (wide > 0xFFFFFF)
    padded = np.zeros(-(-len(wide) // 4) * 4, np.uint8)
    padded[: len(wide)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    split = wide.view(np.uint8).reshape(-1, wide.itemsize)
    return control.astype(np.uint8).tobytes(), split[np.arange(wide.itemsize) <= extra[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks, by table lookup."""
    lengths = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    out = data[at].astype(np.uint32)
    for j in range(1, int(lengths.max(initial=1))):
        has = np.flatnonzero(lengths > j)
        out[has] |= data[at[has] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def _tokenize(path: str, end_id: int, drops_space: bool, added_tokens: bool):
    from tokenizers import Tokenizer

    kind = "<u2" if max(end_id, Tokenizer.from_file(path).get_vocab_size() - 1) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path, drops_space, added_tokens, kind)
        with no_cycle_search():
            for batch in batches:
                for part in slices(batch, "text", TEXT_BYTES):
                    yield pa.RecordBatch.from_arrays([part.column(0), ids.encode_all(part.column(1), end_id)], ["doc_id", "ids"])

    return run, kind


def _count_ids(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                counts = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), kind))
                size = max(len(total), len(counts))
                total = np.pad(total, (0, size - len(total))) + np.pad(counts, (0, size - len(counts)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    return run


def _block(docs: list[tuple[int | None, np.ndarray]], rank_of: np.ndarray) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    control, data = encode_ranks(rank_of[ids])
    body = b"".join(
        [
            struct.pack(_HEAD, MAGIC, len(docs), len(ids), len(control), len(data)),
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
            bytes(d is None for d, _ in docs),
            np.array([len(x) for _, x in docs], "<u4").tobytes(),
            control,
            data,
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def _blocks(kind: str, rank_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int | None, np.ndarray]] = []
        size = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append((doc, np.frombuffer(ids, kind)))
                size += len(docs[-1][1])
                if size >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([_block(docs, rank_of)], pa.binary())], ["block"])
                    docs, size = [], 0
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([_block(docs, rank_of)], pa.binary())], ["block"])

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    drops_space: bool = True,
    added_tokens: bool = False,
) -> None:
    """Files under ``path``/ids, and the ranks under ``path``/ranks.  ``added_tokens``: as in ``pack``."""
    docs, (doc_id, text) = positional(docs, doc_id, text)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    run, kind = _tokenize(tokenizer_path, end_id, drops_space, added_tokens)
    rows = stored(slim.mapInArrow(run, "doc_id long, ids binary"))
    counts = rows.select("ids").mapInArrow(_count_ids(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))  # no more rows than the vocabulary has
    spark = docs.sparkSession
    spark.createDataFrame([(i, r["id"], r["n"]) for i, r in enumerate(ranked)], "rank long, id long, n long").coalesce(1).write.parquet(
        f"{path}/ranks"
    )
    rank_of = np.zeros(max((r["id"] for r in ranked), default=0) + 1, np.uint32)
    rank_of[[r["id"] for r in ranked]] = np.arange(len(ranked))
    files = max(1, -(-4 * sum(r["n"] for r in ranked) // FILE_BYTES))
    # a salt that each row has for itself parts repeated rows of one id among files
    ordered = rows.repartitionByRange(files, F.col("doc_id"), F.xxhash64("ids"), F.monotonically_increasing_id())
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("ids"))
    write_blocks(ordered.mapInArrow(_blocks(kind, rank_of), "block binary"), f"{path}/ids", "block", b"\n")


def _read(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, before = np.frombuffer(content.as_buffer(), np.uint8), 0, 0
                while at < len(data):
                    begin = at
                    magic, n_docs, n_ids, n_control, n_data = struct.unpack_from(_HEAD, data, at)
                    at += struct.calcsize(_HEAD)
                    if magic != MAGIC:
                        raise ValueError(f"{path}: no block at byte {begin}")
                    parts = []
                    for size in (8 * n_docs, n_docs, 4 * n_docs, n_control, n_data):
                        parts.append(data[at : at + size])
                        at += size
                    if zlib.crc32(data[begin:at]) != struct.unpack_from("<I", data, at)[0]:
                        raise ValueError(f"{path}: the block at byte {begin} is damaged")
                    at += 5
                    lengths = parts[2].view("<u4").astype(np.int64)
                    ids = id_of[decode_ranks(parts[3], parts[4], n_ids)].astype("<u4")
                    ends = np.cumsum(lengths)
                    raw = memoryview(ids.tobytes())
                    crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path] * n_docs, pa.string()),
                            pa.array(parts[0].view("<i8").astype(np.int64), pa.int64(), mask=parts[1].astype(bool)),
                            pa.array(before + ends - lengths, pa.int64()),
                            pa.array(lengths, pa.int64()),
                            pa.array(crcs, pa.int64()),
                        ],
                        ["path", "doc_id", "start_in_file", "n_tokens", "ids_crc32"],
                    )
                    before += n_ids

    return run


def file_number() -> Column:
    """The number in a file's name; names of 100,000 files and more don't sort as text."""
    return F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("long")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, decoded from the files."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()  # no more rows than the vocabulary has
    id_of = np.zeros(len(ranks) + 1, np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    rows = stored(
        read_files(spark, f"{path}/ids").mapInArrow(
            _read(id_of), "path string, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"
        )
    )
    files = rows.groupBy("path").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy(file_number()).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row a file
    return rows.join(files, "path").select(
        "doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_files(read_table(spark, sf_dir, "documents"), path, default_path("word_bpe_49k.json"), added_tokens=True)
    return read_token_files(spark, path)
