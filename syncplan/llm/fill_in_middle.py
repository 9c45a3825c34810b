r"""Fill-in-middle by in-place block rotation.

A text is cut into tokens (white space and the word behind it, or white space at the end) and two of its token ends,
drawn from a hash of its id, part it into prefix, middle and suffix.  Its UTF-8 bytes lie in one bytearray with a sentinel
before each part; parts change places by rotations of three reversals each, in place:

* psm: ``P prefix M middle S suffix``; the last two blocks are exchanged: ``P prefix S suffix M middle``.
* spm: the first two blocks of that are exchanged too: ``S suffix P prefix M middle``.

``restore`` finds the sentinels, inverts the rotations and takes the sentinels out, so the text comes back byte for byte.
A text that holds a sentinel isn't transformed, and so none can be mistaken: a sentinel begins with a character that ends
none, and cutting a text puts no new one together.

Nulls and odd input: a null or empty text has no tokens and stays plain, as an empty text; a null id is drawn for as an
empty one; repeated rows are transformed alike; long texts are worked on whole, beside numpy's positions of their token
ends; an empty table gives no rows.  Other columns stay, whatever their names.  The new column is named ``fim``, with
underscores behind it where the table has such a column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh, positional, read_table
from .words import NON_SPACE, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that a reversal holds beside the text.
_REVERSED = 1 << 16
FIM = StructType(
    [
        StructField("form", StringType()),
        StructField("text", StringType()),
        StructField("tokens", LongType()),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
    ]
)


@dataclass(frozen=True)
class Rates:
    """Which texts change: percent that do, percent of those that become spm, and the seed of all draws."""

    transformed: int = 50
    spm: int = 80
    seed: int = 42

    def draws(self, doc_id: int | None) -> list[int]:
        """Four 32-bit numbers of a document: two for its cuts, one for its form, one for the order."""
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def token_ends(body: np.ndarray) -> np.ndarray:
    """Where tokens end: behind each word, and at the end of white space that no word follows.

    White space is ASCII, so bytes of UTF-8 tell it.
    """
    word = NON_SPACE[body]
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    return np.append(ends, len(body)) if len(body) else ends


def _reverse(buffer: np.ndarray, begin: int, end: int) -> None:
    """In place, by blocks from both ends."""
    while end - begin > 1:
        n = min(_REVERSED, (end - begin) // 2)
        head = buffer[begin : begin + n].copy()
        buffer[begin : begin + n] = buffer[end - n : end][::-1]
        buffer[end - n : end] = head[::-1]
        begin, end = begin + n, end - n


def rotate(buffer: np.ndarray, begin: int, middle: int, end: int) -> int:
    """Exchanges the blocks begin:middle and middle:end by three reversals; returns where they meet now."""
    _reverse(buffer, begin, middle)
    _reverse(buffer, middle, end)
    _reverse(buffer, begin, end)
    return begin + end - middle


def _insert(body: bytearray, cuts: tuple[int, int]) -> tuple[int, int]:
    """Puts the sentinels of prefix, middle and suffix before their parts; returns where the last two begin."""
    first, second = cuts
    body[second:second] = SUFFIX.encode()
    body[first:first] = MIDDLE.encode()
    body[0:0] = PREFIX.encode()
    middle = len(PREFIX) + first
    return middle, middle + len(MIDDLE) + second - first


def _chars(body: memoryview | bytes | bytearray) -> int:
    """Code points: bytes that begin one."""
    return int(np.count_nonzero((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)) if len(body) else 0


def transform(text: str | None, doc_id: int | None, rates: Rates = Rates()) -> tuple[str, str, int, int | None, int | None]:
    """A row of FIM."""
    body = bytearray((text or "").encode())
    ends = token_ends(np.frombuffer(body, np.uint8))
    n = len(ends)
    h1, h2, h3, h4 = rates.draws(doc_id)
    if not body or any(s.encode() in body for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rates.transformed:
        return PLAIN, text or "", n, None, None
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, inner = _chars(body[:first]), _chars(body[first:second])
    middle, suffix = _insert(body, (first, second))
    view = np.frombuffer(body, np.uint8)
    suffix_end = rotate(view, middle, suffix, len(body))  # P prefix | S suffix | M middle
    form = SPM if h4 % 100 < rates.spm else PSM
    if form == SPM:
        rotate(view, 0, middle, suffix_end)  # S suffix | P prefix | M middle
    return form, body.decode(), n, prefix, inner


def restored(text: str, form: str) -> str:
    """The text before ``transform``."""
    if form == PLAIN:
        return text
    body = bytearray(text.encode())
    view = np.frombuffer(body, np.uint8)
    last = body.index(MIDDLE.encode())
    middle = rotate(view, 0, body.index(PREFIX.encode()), last) if form == SPM else body.index(SUFFIX.encode())
    suffix = rotate(view, middle, last, len(body))  # P prefix | M middle | S suffix
    del view  # a bytearray that is viewed can't shrink
    del body[suffix : suffix + len(SUFFIX)]
    del body[middle : middle + len(MIDDLE)]
    del body[: len(PREFIX)]
    return body.decode()


def _with_last(kind: pa.DataType, key: str, text: str, make):
    """Adds to each batch a last column of ``make``'s results for the columns ``key`` and ``text``, which go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                at = part.schema.get_field_index(key), part.schema.get_field_index(text)
                made = [make(t, k) for k, t in zip(part.column(at[0]).to_pylist(), part.column(at[1]).to_pylist(), strict=True)]
                rest = [i for i in range(part.num_columns) if i not in at]
                columns = [*(part.column(i) for i in rest), pa.array(made, kind)]
                yield pa.RecordBatch.from_arrays(columns, [*(part.schema.names[i] for i in rest), "made"])

    return run


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rates: Rates = Rates()) -> DataFrame:
    """The columns of ``docs`` and FIM: the form, the transformed text, the text's tokens and lengths of its parts."""
    rows, (key, body) = positional(docs, doc_id, text)
    rows = rows.withColumns({"key": F.col(key).cast("long"), "body": F.col(body).cast("string")})
    names = [f.name for f in FIM.fields]
    kind = pa.struct([(n, pa.string() if n in ("form", "text") else pa.int64()) for n in names])
    make = lambda t, k: dict(zip(names, transform(t, k, rates), strict=True))
    schema = StructType([*docs.schema.fields, StructField(fresh(docs, "fim")[0], FIM)])
    return rows.mapInArrow(_with_last(kind, "key", "body", make), schema)


def restore(rows: DataFrame, fim: str = "fim") -> DataFrame:
    """Adds the text before ``fill_in_middle``, from the transformed one and its form, as column ``restored``."""
    given, (made,) = positional(rows, fim)
    given = given.withColumns({"form": F.col(made)["form"], "body": F.col(made)["text"]})
    schema = StructType([*rows.schema.fields, StructField(fresh(rows, "restored")[0], StringType())])
    return given.mapInArrow(_with_last(pa.string(), "form", "body", restored), schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return restore(made).select(
        "doc_id",
        F.col("fim.tokens").alias("n"),
        F.col("fim.form").alias("form"),
        F.col("fim.prefix_chars").alias("prefix_chars"),
        F.col("fim.middle_chars").alias("middle_chars"),
        F.sha2(F.col("fim.text"), 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


#: For the rows of the query.  ``list_sum`` of token lengths gives cuts in code points.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
  CAST(concat('0x', substring(h, 1, 8)) AS BIGINT) AS h1, CAST(concat('0x', substring(h, 9, 8)) AS BIGINT) AS h2,
  CAST(concat('0x', substring(h, 17, 8)) AS BIGINT) AS h3, CAST(concat('0x', substring(h, 25, 8)) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(tokens) AS n, h1 % (len(tokens) + 1) AS a, h2 % (len(tokens) + 1) AS b FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(list_slice(tokens, 1, least(a, b)), '') AS p, array_to_string(list_slice(tokens, least(a, b) + 1, greatest(a, b)), '') AS m,
  array_to_string(list_slice(tokens, greatest(a, b) + 1, len(tokens)), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
 CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM f"""
