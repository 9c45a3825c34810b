"""Secret scan over a trigram inverted index.

Each rule's pattern gives a Boolean query of trigrams that every match must hold (of text in ASCII lower case).  The
index lists, for each trigram that some query asks for and each block of rows, the rows that hold it.  A query is
answered block by block: AND intersects postings, OR joins them.  Only the rows that it leaves are verified with the
pattern.  A pattern without mandatory trigrams (such as plain hexadecimal) is matched against all rows.

Trigram queries are derived from the pattern's parse tree.  A literal run gives its trigrams; branches are OR; optional
parts and repeats from zero end a run; a part repeated at least once ends a run after itself.  A query that would take
more than ``MOST`` alternatives is weakened, never strengthened.

Blocks hold a bounded number of rows, so postings of a common trigram are many short lists, not one long one.

Nulls and odd input: a null text is empty; a null doc_id is carried; repeated rows each get a row of the result.  Rows
are known by two hashes of their id and text, so equal rows share postings.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache_of, positional, read_table, row_key, stored, with_length
from .words import slices

try:  # its place in the standard library
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse

#: Alternatives of a query, at most.
MOST = 32
#: Rows of an index block, about.
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Rule:
    """``pattern``: its matches (of ``group``) are spans of ``kind`` if they have ``least`` characters in ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules come first and in this order.  Fixed values.
BASE = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: What the method adds.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE


# A query is a set of alternatives, each a set of trigrams; {frozenset()} asks for nothing.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _fold(char: int) -> str:
    return chr(char + 32 if 65 <= char <= 90 else char)


def _trigrams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def _least(query: set[frozenset[str]]) -> Query:
    """Without alternatives that ask for more than another one does."""
    kept = [q for q in query if not any(other < q for other in query)]
    return frozenset(kept)


def trigram_query(pattern: str) -> Query:
    """What every match of the pattern must hold."""

    def walk(items, state: list[tuple[frozenset[str], str]]) -> list[tuple[frozenset[str], str]]:
        """state: alternatives so far, each its trigrams and the literal run that ends it."""
        for op, arg in items:
            if op is sre.LITERAL and arg < 0x80:
                state = [(q | _trigrams(run[-2:] + _fold(arg)), run[-2:] + _fold(arg)) for q, run in state]
            elif op is sre.IN and (few := _few(arg)) and len(state) * len(few) <= MOST:
                state = [(q | _trigrams(run[-2:] + c), run[-2:] + c) for q, run in state for c in few]
            elif op is sre.SUBPATTERN:
                state = walk(arg[-1], state)
            elif op is sre.BRANCH:
                each = [x for branch in arg[1] for x in walk(branch, state)]
                state = each if len(each) <= MOST else [(q, "") for q, _ in state]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1:
                each = [*state, *walk(arg[2], state)]
                state = each if len(each) <= MOST else [(q, "") for q, _ in state]
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                state = [(q, "") for q, _ in walk(arg[2], state)]
            elif op is sre.AT:
                continue
            else:
                state = [(q, "") for q, _ in state]
            state = list(dict.fromkeys(state))
        return state

    def _few(members) -> list[str]:
        out: set[str] = set()
        for op, arg in members:
            if op is sre.LITERAL and arg < 0x80:
                out.add(_fold(arg))
            elif op is sre.RANGE and arg[1] < 0x80 and arg[1] - arg[0] < 8:
                out.update(_fold(c) for c in range(arg[0], arg[1] + 1))
            else:
                return []
        return sorted(out) if len(out) <= 8 else []

    return _least({q for q, _ in walk(sre_parse.parse(pattern), [(frozenset(), "")])})


@cache
def _compiled(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern)


def spans_of(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points, without those that are too short."""
    if rule.kind == "hex":  # most texts have none; a plain search is quicker than all its runs
        if not _LONG_HEX.search(text):
            return []
    return [m.span() for m in _compiled(rule).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


_LONG_HEX = re.compile("[0-9a-f]{16}")


def _postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """``block, trigram, rows``: which rows of the block (k1) hold the trigram.  Empty lists are left out."""
    held = [F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]
    each = rows.select(
        "block", "k1", F.explode(F.array_compact(F.array(*held))).alias("trigram")
    )
    return each.groupBy("block", "trigram").agg(F.collect_set("k1").alias("rows"))


def _answer(query: Query) -> Column:
    """Rows of one block that satisfy the query; ``held`` maps each of the block's trigrams to its rows."""

    def of(trigram: str) -> Column:
        return F.coalesce(F.try_element_at("held", F.lit(trigram)), F.array().cast("array<bigint>"))

    parts = []
    for need in sorted(query, key=sorted):
        both = None
        for trigram in sorted(need):
            both = of(trigram) if both is None else F.array_intersect(both, of(trigram))
        parts.append(both)
    out = parts[0]
    for part in parts[1:]:
        out = F.array_union(out, part)
    return out


def _marked(rows: Column, bit: int) -> Column:
    return F.transform(rows, lambda k: F.struct(k.alias("k1"), F.lit(bit).cast("long").alias("bit")))


def _scan(rules: tuple[Rule, ...], full: tuple[bool, ...]):
    """Spans of each row; a rule with postings runs only where ``candidates`` has its bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_of("secrets")
        for whole in batches:
            for batch in slices(whole, "text"):
                found: list[list[tuple[int, int, int]]] = []
                for text, bits in zip(batch.column("text").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                    spans = []
                    for i, rule in enumerate(rules):
                        if full[i] or bits >> i & 1:
                            spans += [(start, i, end) for start, end in spans_of(rule, text)]
                    found.append(sorted(spans))
                flat = [x for spans in found for x in spans]
                each = pa.StructArray.from_arrays(
                    [pa.array([rules[i].kind for _, i, _ in flat], pa.string()), *(pa.array([x[j] for x in flat], pa.int64()) for j in (0, 2))],
                    ["kind", "start", "end"],
                )
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), each)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "doc_id")), lists], ["k1", "k2", "doc_id", "spans"])

    return run


def secret_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``k1, k2, doc_id, spans`` for each row; spans (kind, start, end) by start, then in the order of the rules."""
    docs, (doc_id, text) = positional(docs, doc_id, text)
    slim = docs.select(
        *row_key(doc_id, text),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    queries = [trigram_query(r.pattern) for r in rules]
    full = tuple(q == ANY for q in queries)
    trigrams = sorted({t for q in queries for need in q for t in need})
    blocks = max(8, -(-docs.count() // block_rows))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = slim.select("k1", F.pmod("k1", F.lit(blocks)).alias("block"), lower.alias("low"))
    index = stored(_postings(keyed, trigrams))
    held = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("held"))
    hits = [_marked(_answer(q), 1 << i) for i, q in enumerate(queries) if not full[i]]
    found = held.select(F.explode(F.flatten(F.array(*hits))).alias("x")).groupBy("x.k1").agg(F.bit_or("x.bit").alias("candidates"))
    joined = slim.join(stored(found).hint("shuffle_hash"), "k1", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("long")))
    return joined.mapInArrow(
        _scan(rules, full), "k1 long, k2 long, doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_spans(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", *(of(r.kind) for r in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def _masked(text: str, spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lists = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index(spans)).to_pylist()
            out = []
            for whole, own in zip(batch.column(at).to_pylist(), lists, strict=True):
                parts, done = [], 0
                for s in own:  # ascending; overlaps become one mask
                    if s["end"] <= done:
                        continue
                    parts += [whole[done : max(done, s["start"])], "[secret]" if s["start"] >= done else ""]
                    done = s["end"]
                out.append("".join(parts) + whole[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).drop_columns([spans])

    return run


def mask_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with ``[secret]`` in place of each span, in the columns of ``docs``; ``n_chars`` follows the text.

    Columns of any name come through as they are; rows with equal id and text are masked alike.
    """
    plain, (key, body) = positional(docs, doc_id, text)
    found = secret_spans(plain, key, body, **options).filter("size(spans) > 0").select("k1", "k2", "spans").dropDuplicates(["k1", "k2"])
    keyed = plain.withColumns(dict(zip(("k1", "k2"), row_key(key, body), strict=True)))
    joined = keyed.join(stored(found).hint("shuffle_hash"), ["k1", "k2"], "left").select(*plain.columns, "spans")
    clean = joined.filter("spans is null").select(*plain.columns)
    masked = joined.filter("spans is not null").mapInArrow(_masked(body, "spans"), plain.schema)
    return clean.unionByName(with_length(masked, docs, body)).toDF(*docs.columns)


def brute_force(doc_id: int | None, text: str | None, rules: tuple[Rule, ...] = RULES) -> tuple:
    """The query's row for one text, without an index; for tests."""
    spans = []
    for i, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                spans.append((m.start(), i, m.end()))
    listed = [(rules[i].kind, s, e) for s, i, e in sorted(spans)]
    base = [x for x in listed if x[0] in {r.kind for r in BASE}]
    text_of = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
    counts = [sum(x[0] == r.kind for x in base) for r in BASE]
    return (doc_id, *counts, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(listed))


def _sql() -> str:
    """DuckDB SQL for the query: matches are marked in the text, which is then parted at the marks."""
    begin, end = "chr(57344)", "chr(57345)"  # private characters
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    # the least lengths of these two hold for a whole run or not at all
    own = {"assign": f"({names})" + BASE[0].pattern.split("key))", 1)[1], "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
    found = []
    for i, rule in enumerate(RULES):
        pattern = own.get(rule.kind, rule.pattern).replace("'", "''")
        found.append(f"""
  SELECT rid, '{rule.kind}' AS kind, {i} AS place, x.s AS s, x.s + length(x.m) AS e
  FROM (SELECT rid, unnest(list_transform(range(2, len(p) + 1), lambda k: {{'s': CAST(list_sum(list_transform(p[1:k - 1], lambda y: length(y))) AS BIGINT) - (k - 2), 'm': split_part(p[k], {end}, 1)}})) AS x
        FROM (SELECT rid, string_split(regexp_replace(text, '({pattern})', {begin} || '\\1' || {end}, 'g'), {begin}) AS p FROM d))
  WHERE length(regexp_extract(x.m, '{pattern}', {rule.group})) >= {rule.least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(found)}
),
g AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS c, count(*) FILTER (WHERE kind = 'hex') AS h,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (WHERE place < {len(BASE)}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
  FROM f GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


OP4_SQL = _sql()
