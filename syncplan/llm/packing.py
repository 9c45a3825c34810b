"""Hierarchical multi-length packing of token sequences.

Documents are routed to context-size tiers (2048, 1024, 512 and 256 tokens): each full window of the longest tier stands
alone, the rest of a document goes to the smallest tier that holds it.  Tiers are packed from the longest down: a gap
in a long window is filled with the longest pieces of shorter tiers that fit, and then by cutting one piece.  Windows
are full, and their sizes are powers of two; what is left at the end of a partition is cut into windows of descending
powers of two, so no sequence is padded.  Step groups gather windows, whatever their tier, until they hold the same
number of tokens.

Packing works on one partition of documents at a time, in pools of bounded size, so it needs no shuffle, and a lost
task is packed again from its own rows.  Sequence ids carry the partition's number and so are unique.

Nulls and odd input: a null text is empty and gives its end id alone; a null doc_id is carried; repeated rows are
packed once each; a document of any length is cut into windows; an empty table gives no rows.  Other columns are not
read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import positional, read_table
from .tokens import default_path, encoder, no_cycle_search
from .words import slices

TIERS = (2048, 1024, 512, 256)
#: Tokens held before a pool is packed.
POOL_TOKENS = 1 << 20
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " tier int, sequence_tokens int, step_group long"
)


@dataclass(order=True)
class Piece:
    """``ids``: four bytes each; ``key`` breaks ties in the order of arrival."""

    length: int
    key: int
    doc: int | None = field(compare=False)
    start: int = field(compare=False)
    total: int = field(compare=False)
    ids: memoryview = field(compare=False)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(n, self.key, self.doc, self.start, self.total, self.ids[: 4 * n]),
            Piece(self.length - n, self.key, self.doc, self.start + n, self.total, self.ids[4 * n :]),
        )


class Packer:
    """Windows of the pieces that are added; ``emit(tier, pieces)`` takes each finished window."""

    def __init__(self, emit, tiers: tuple[int, ...] = TIERS):
        self.emit, self.tiers, self.pool, self.tokens, self.n = emit, tiers, [], 0, 0

    def add(self, doc: int | None, ids: bytes) -> None:
        view, total, longest = memoryview(ids), len(ids) // 4, self.tiers[0]
        for start in range(0, total, longest):
            piece = Piece(min(longest, total - start), self.n, doc, start, total, view[4 * start : 4 * (start + longest)])
            self.n += 1
            if piece.length in self.tiers:  # a window of its own
                self.emit(piece.length, [piece])
            else:
                self.pool.append(piece)
                self.tokens += piece.length
        if self.tokens >= POOL_TOKENS:
            self.pack(last=False)

    def _windows(self) -> Iterator[tuple[int, list[Piece]]]:
        """Windows of the pool; those that no piece can fill come last, and empty it."""
        self.pool.sort()
        pool, short = self.pool, []
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while pool and pool[-1].length > below:
                window = [pool.pop()]
                gap = tier - window[0].length
                while gap and pool:
                    at = bisect_right(pool, gap, key=lambda p: p.length)
                    if at:  # the longest that fits
                        piece = pool.pop(at - 1)
                    else:
                        piece, rest = pool.pop(0).cut(gap)
                        insort(pool, rest)
                    window.append(piece)
                    gap -= piece.length
                if gap:
                    short.append((tier, window))
                else:
                    yield tier, window
        yield from short

    def pack(self, last: bool) -> None:
        left: list[Piece] = []
        for tier, window in self._windows():
            if last or sum(p.length for p in window) == tier:
                self.emit(tier, window)
            else:
                left += window  # waits for the next pool
        self.pool, self.tokens = left, sum(p.length for p in left)


def _shrunk(window: list[Piece]) -> Iterator[tuple[int, list[Piece]]]:
    """A window that isn't full, as full ones of descending powers of two, so nothing is padded."""
    room = sum(p.length for p in window)
    while window:
        size, out = 1 << room.bit_length() - 1, []
        need = size
        while need:
            piece = window.pop(0)
            if piece.length > need:
                piece, rest = piece.cut(need)
                window.insert(0, rest)
            out.append(piece)
            need -= piece.length
        room -= size
        yield size, out


def _pack_partition(path: str, end_id: int, tiers: tuple[int, ...], step_tokens: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path, drops_space=False, added_tokens=added_tokens)
        end = np.array([end_id], "<u4").tobytes()
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        rows: list[tuple] = []
        state = {"sequence": 0, "group": 0, "room": step_tokens}

        def window(tier: int, pieces: list[Piece]) -> None:
            if state["room"] < tier:
                state["group"] += 1
                state["room"] = step_tokens
            state["room"] -= tier
            offset, used = 0, sum(p.length for p in pieces)
            for p in pieces:
                crc = zlib.crc32(p.ids)
                rows.append((p.doc, p.start, p.length, crc, p.total, base + state["sequence"], offset, tier, used, base + state["group"]))
                offset += p.length
            state["sequence"] += 1

        def emit(tier: int, pieces: list[Piece]) -> None:
            if sum(p.length for p in pieces) == tier:
                window(tier, pieces)
            else:
                for size, part in _shrunk(pieces):
                    window(size, part)

        def out() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECES.split(",")]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return batch

        packer = Packer(emit, tiers)
        with no_cycle_search():
            for batch in batches:
                for part in slices(batch, "text"):
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        packer.add(doc, ids.encode(text) + end)
                    if len(rows) > 20_000:
                        yield out()
            packer.pack(last=True)
        yield out()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = 64 * 2048,
    added_tokens: bool = False,
) -> DataFrame:
    """One row for each piece: PIECES.  ``sequence_tokens`` are used; ``tier`` is the window's size.

    With ``added_tokens``, contents of the vocabulary's added tokens get their ids, as in the library's ``encode``.
    """
    docs, (doc_id, text) = positional(docs, doc_id, text)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_pack_partition(tokenizer_path, end_id, tiers, step_tokens, added_tokens), PIECES)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), added_tokens=True)
