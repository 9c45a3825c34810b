"""Words of many texts at once: byte-level splitting and hashing with numpy.

Texts come as one Arrow string array.  All work is on its UTF-8 bytes, so a class of word characters that holds
every byte from 0x80 up, or none of them, treats code points rightly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import cache_of

#: Words ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text in lower case.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text that are worked on together; an array of eight bytes a byte of text takes eight times this.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
STEP = np.uint64(0xD1342543DE82EF95)
STEP_INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(base: np.uint64, n: int) -> np.ndarray:
    kept = cache_of("words")
    have = kept.get(int(base))
    if have is None or len(have) < n:
        factors = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        if n <= 4 * SLICE_BYTES:
            kept[int(base)] = have
    return have[:n]


@dataclass
class Words:
    """``start`` and ``end`` are byte places in ``data``; ``row`` is the text's row; ``hash`` depends on the word's bytes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    n_rows: int
    row_start: np.ndarray  # byte place at which each text begins

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of the texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, keep: np.ndarray, lower: bool = True) -> Words:
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = keep[data]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    ends = ~inside[1:] & inside[:n]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]  # a text's first byte begins a word, its last one ends one
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n + 1)[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * powers(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, row, hashed, len(offsets) - 1, offsets[:-1])


def shingles(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, first word, hash)`` of every run of k words of a text, in order.

    short: a text of fewer than k words, but not none, gives its whole sequence as one.
    """
    n = len(words.row)
    row = words.row
    first = np.flatnonzero(row[: max(0, n - k + 1)] == row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    value = np.zeros(len(first), np.uint64)
    factors = [np.uint64(pow(int(STEP), j, 1 << 64)) for j in range(k)]
    for j in range(k):
        value += words.hash[first + j] * factors[j]
    value = mix(value + np.uint64(k))
    rows = row[first]
    if short:
        counts = words.counts()
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            at = np.searchsorted(row, few)
            sums = np.zeros(len(few), np.uint64)
            for j in range(k - 1):
                has = counts[few] > j
                sums[has] += words.hash[at[has] + j] * factors[j]
            rows = np.concatenate([rows, few])
            first = np.concatenate([first, at])
            value = np.concatenate([value, mix(sums + counts[few].astype(np.uint64))])
            order = np.argsort(rows, kind="stable")
            rows, first, value = rows[order], first[order], value[order]
    return rows, first, value


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text each, or a single row."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), np.int64)
    total = np.cumsum(size)
    begin = 0
    while begin < n:
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
