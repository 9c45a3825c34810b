"""Removal of passages that repeat across documents, by hashing of lines, paragraphs and passages.

Three kinds of unit are hashed: whole lines, paragraphs (runs of lines without a blank one between them), and, as repeated
passages also begin and end amid lines, passages of ``window`` words.  Those begin at places that the words themselves
choose, the least hash of two neighbouring words among each ``reach`` places in a row, so equal passages give equal units
wherever they stand.  Units are normalised (ASCII lower case, one space between words) and hashed; digests are grouped over
all documents, and the earliest occurrence (smallest doc id, then place) of each is kept.  In every other occurrence its
words are removed.  Units that overlap and have their earliest occurrence in one document are one row.  Spans are in code
points of the original text.

A line of fewer than ``min_line_words`` words that an earlier document holds, as it may hold a common phrase or a licence,
goes only with a neighbour: where the words right before or behind it go.  By default there are no such lines.

Every removed word thus lies in a line, a paragraph or ``window`` words one after the other that one earlier document (or an
earlier place of the same one) holds as they are.  A passage of at least ``window`` + ``reach`` - 1 words (25) that an earlier
document holds is always met; of one that begins or ends amid a line, fewer than ``reach`` words at its start and as many at
its end stay, and about half as many as a rule.

Data flow: units are stored once, as arrays, and of units that a document holds more than once only the first is sent.  The
grouping sums before the shuffle; the digests found are stored, so that adaptive execution can split the join where a digest
has very many rows.

Nulls and odd input: a null text has no units; a row with a null doc id ranks after all others and rows without an id
that hold the same units are one document; so are repeated rows of one id.  An empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, positional, read_table, row_key, stored
from .words import NON_SPACE, STEP, STEP_INVERSE, Words, mix, powers, slices, words_of

_LAST = 2**63 - 1
UNITS = (
    "rid long, k1 long, k2 long, doc_id long, digests array<long>, firsts array<boolean>, at array<int>, words array<int>,"
    " starts array<int>, ends array<int>, weak array<boolean>"
)
#: Words of a passage, and places in a row of which one begins a passage.
WINDOW, REACH = 16, 10


def _places(words: Words, window: int, reach: int) -> np.ndarray:
    """Words at which a passage of ``window`` words begins: the least of each ``reach`` places in a row, the last of equal ones."""
    n = len(words.row)
    if n < max(window, reach + 1):
        return np.zeros(0, np.int64)
    value = mix(words.hash[:-1] * np.uint64(3) + words.hash[1:])
    near = np.lib.stride_tricks.sliding_window_view(value, reach)
    least = np.arange(len(near)) + reach - 1 - near[:, ::-1].argmin(axis=1)
    inside = words.row[: len(near)] == words.row[reach : reach + len(near)]
    place = np.unique(least[inside])
    place = place[place + window <= n]
    return place[words.row[place] == words.row[place + window - 1]]


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each line, and of each paragraph of several lines."""
    n = len(words.row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.diff(np.cumsum(words.data == 10)[words.start])
    found = []
    for ends in (step > 0, step > 1):
        new = np.append(True, ends | (words.row[1:] != words.row[:-1]))
        begin = np.flatnonzero(new)
        found.append((begin, np.diff(np.append(begin, n))))
    return np.concatenate([b for b, _ in found]), np.concatenate([k for _, k in found])


def _units(min_line_words: int, window: int, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(3), NON_SPACE)
                n, place = len(words.row), _places(words, window, reach)
                begin, size = _lines(words)
                begin, size = np.concatenate([begin, place]), np.concatenate([size, np.full(len(place), window)])
                order = np.lexsort((size, begin))
                begin, size = begin[order], size[order]
                new = np.ones(len(begin), bool)  # a line of just so many words is also a passage
                new[1:] = (begin[1:] != begin[:-1]) | (size[1:] != size[:-1])
                begin, size = begin[new], size[new]
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(words.hash * powers(STEP, n + 1)[:n], out=total[1:])
                digest = mix((total[begin + size] - total[begin]) * powers(STEP_INVERSE, n + 1)[begin] + size.astype(np.uint64))
                row = words.row[begin] if n else np.zeros(0, np.int64)
                order = np.lexsort((begin, digest, row))  # of each row and digest the first
                first = np.zeros(len(begin), bool)
                first[order] = np.append(True, (digest[order][1:] != digest[order][:-1]) | (row[order][1:] != row[order][:-1]))[: len(order)]
                points = np.zeros(len(words.data) + 1, np.int64)
                np.cumsum((words.data & 0xC0) != 0x80, out=points[1:])
                base = points[words.row_start]
                offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                before = np.searchsorted(words.row, np.arange(part.num_rows))
                each = [
                    pa.array(digest.view(np.int64)),
                    pa.array(first),
                    pa.array(begin - before[row], pa.int32()),
                    pa.array(size, pa.int32()),
                    pa.array(points[words.start[begin]] - base[row], pa.int32()),
                    pa.array(points[words.end[begin + size - 1]] - base[row], pa.int32()),
                    pa.array((size < min_line_words) & (size != window)),
                ]
                ids = pa.array(np.arange(rid, rid + part.num_rows), pa.int64())
                rid += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [ids, *part.columns[:3], *(pa.ListArray.from_arrays(offsets, x) for x in each)],
                    [x.split()[0] for x in UNITS.split(", ")],
                )

    return run


SPANS = "doc_id long, k1 long, k2 long, start long, end long, n_words long, first_doc_id long"


def _spans(doc: int, digests: list[int], at: list[int], words: list[int], weak: list[bool], found: dict[int, int]) -> Iterator[tuple[int, int, int, int]]:
    """``(first unit, last unit, words, earliest document)`` of each stretch to remove; ``found`` has units by place."""
    source = {digests[u]: of for u, of in found.items()}
    begins, ends = set(), set()  # of what goes
    kept_until: dict[int, int] = {}  # the word after the occurrence of a digest that this document keeps
    chosen: dict[int, list[int]] = {}
    for u, digest in enumerate(digests):
        if weak[u]:
            continue
        if u in found:
            chosen.setdefault(found[u], []).append(u)
        elif digest in source:  # again in this document
            chosen.setdefault(source[digest], []).append(u)
        elif at[u] >= kept_until.setdefault(digest, at[u] + words[u]) and at[u] + words[u] > kept_until[digest]:
            chosen.setdefault(doc, []).append(u)
    for of, units in chosen.items():
        i = 0
        while i < len(units):
            j, end, last = i, at[units[i]] + words[units[i]], units[i]
            while j + 1 < len(units) and at[units[j + 1]] < end:
                j += 1
                if at[units[j]] + words[units[j]] > end:
                    end, last = at[units[j]] + words[units[j]], units[j]
            yield units[i], last, end - at[units[i]], of
            begins.add(at[units[i]])
            ends.add(end)
            i = j + 1
    short = [u for u in range(len(digests)) if weak[u] and digests[u] in source]
    with_neighbour = set()
    for u in short:
        if at[u] in ends:
            with_neighbour.add(u)
            ends.add(at[u] + words[u])
    for u in reversed(short):
        if at[u] + words[u] in begins:
            with_neighbour.add(u)
            begins.add(at[u])
    for u in sorted(with_neighbour):
        yield u, u, words[u], source[digests[u]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SPANS.split(", ")]
    for batch in batches:
        rows = []
        columns = (batch.column(i).to_pylist() for i in range(batch.num_columns))
        for k1, k2, doc, digests, at, words, starts, ends, weak, units, sources in zip(*columns, strict=True):
            own = _LAST if doc is None else doc
            for a, b, n, of in _spans(own, digests, at, words, weak, dict(zip(units or (), sources or (), strict=True))):
                rows.append((doc, k1, k2, starts[a], ends[b], n, None if of == _LAST else of))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_line_words: int = 1, window: int = WINDOW, reach: int = REACH
) -> DataFrame:
    """A row for each span to remove: SPANS.  ``first_doc_id`` holds the earliest occurrence of its units.

    Rows of one document overlap where their words come from several earlier documents.
    """
    plain, (key, body) = positional(docs, doc_id, text)
    slim = plain.select(*row_key(key, body), F.col(key).cast("long").alias("doc_id"), F.col(body).cast("string").alias("text"))
    rows = stored(slim.mapInArrow(_units(min_line_words, window, reach), UNITS))
    each = rows.select("rid", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "firsts", F.posexplode("digests").alias("unit", "digest"))
    each = each.filter(F.get("firsts", "unit")).drop("firsts")
    first = each.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    first = stored(first.drop("last"))
    again = (
        each.join(first, "digest")
        .filter("doc > first")
        .groupBy("rid")
        .agg(F.collect_list(F.struct("unit", "first")).alias("found"))
        .select("rid", F.col("found.unit").alias("units"), F.col("found.first").alias("sources"))
    )
    whole = rows.join(again, "rid", "left").filter(F.col("units").isNotNull() | F.exists("firsts", lambda x: ~x))
    whole = whole.select("k1", "k2", "doc_id", "digests", "at", "words", "starts", "ends", "weak", "units", "sources")
    return whole.mapInArrow(_runs, SPANS).distinct()  # repeated rows give the same spans


def _cut(text: str, removed: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index(removed)).to_pylist()
            out = []
            for whole, own in zip(batch.column(at).to_pylist(), spans, strict=True):
                parts, done = [], 0
                for s in own:  # ascending; they may overlap
                    parts.append(whole[done : max(done, s["start"])])
                    done = max(done, s["end"])
                out.append("".join(parts) + whole[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without their repeated lines and passages, and ``removed``: spans in the original text.

    Columns of any name come through as they are.  Where ``docs`` has a column ``removed``, the new one is ``removed_``.
    """
    plain, (key, body) = positional(docs, doc_id, text)
    spans = repeated_spans(plain, key, body, **options).groupBy("k1", "k2")
    spans = spans.agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    keyed = plain.withColumns(dict(zip(("k1", "k2"), row_key(key, body), strict=True)))
    joined = keyed.join(stored(spans), ["k1", "k2"], "left").select(*plain.columns, "removed")
    cut = joined.filter(F.col("removed").isNotNull()).mapInArrow(_cut(body, "removed"), joined.schema)
    return joined.filter(F.col("removed").isNull()).unionByName(cut).toDF(*docs.columns, *fresh(docs, "removed"))


#: Words of a line that the query removes by itself.  Half of the documents hold some shorter one that others hold too.
LINE_WORDS = WINDOW


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(read_table(spark, sf_dir, "documents"), min_line_words=LINE_WORDS)
    return found.select("doc_id", "start", "end", "n_words", "first_doc_id")
