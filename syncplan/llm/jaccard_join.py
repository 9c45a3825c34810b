"""N-gram Jaccard join with several global token orders, and the groups that its links form.

A document's set holds its distinct shingles of ``k`` words.  Documents with equal sets are one class.  Two classes
link when 100 * intersection >= ``percent`` * union.

Prefix filtering: under any total order of tokens, two sets of sizes n and n' that link have at least
t = percent * (n + n') / (100 + percent) tokens in common, and so share one of the first n - t + 1 tokens of each (the
prefix).  Three orders are used that differ in kind: rare tokens first (held by fewer classes), a hash of the token, and
frequent tokens first; a pair must share a prefix token under each of them before its sets are compared.  So sets that share
rare tokens alone, as texts with a common passage do, fail under the other two, and pages of one template under the first.
A token that only one class holds can't be shared, so it counts as unlike at once; a class with too few shared tokens links
with nothing and is left out early, which is all but near copies.

Large groups aren't compared in all pairs.  Each member of a token's list is first compared with one member of the list
(the hub: the one with the largest share of shared tokens, as the source of copies has; then another one), which settles
most of a group.  Then only pairs whose groups still differ meet, at a token and a band of sizes where enough shared tokens
are left in both; members of a list's largest group don't meet one another.  No link between groups is lost by that: a pair
that links has enough tokens left at its first common token.  Where they meet, a pair is made only if the bits of its sets
allow a link: each set has BITS bits, of which each token turns one, so two sets differ in as many tokens at least as in
bits.  Pages of one template, whose other words are few and frequent, meet at many tokens and fail there.

Data flow: tokens travel in packed arrays by ranges of token, and what is shared from there by class.  With more than
``FAN`` ranges they are dealt in two or more steps, so arrays don't become short as the input grows.  A token that ``HOT``
classes of one stretch of documents hold is sent once a stretch, not once a document; each step looks again, so a token
that a third of all documents hold loads no task.  Tokens are 48 bits of a 64-bit hash; a pair of sets of 500 tokens has a
chance of one in 10**9 to be counted one token too close.

Nulls and odd input: a null text, or one without words, has no shingles and links with nothing; fewer than k words give
one shingle, the whole sequence; rows with a null doc id link nothing and have no component unless their class has other
rows; repeated rows are in one class and each get a row of the result; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import positional, power_of_two, read_table, row_key, stored, text_bytes
from .components import merge_labels
from .words import NON_SPACE, mix, shingles, slices, words_of

#: Tokens that one stretch of documents gathers before it is sent, and tokens that one range holds, about.
STRETCH = 500_000
RANGE_TOKENS = 2_000_000
#: Ranges at least: what a class gets back comes in as many rows at most, and so in no more where the input grows a little.
LEAST_RANGES = 128
#: Ranges that one step deals out, at most.
FAN = 4096
#: Classes of a stretch that make a token hot there.
HOT = 64
TOKEN_BITS = 48
ORDERS = 3
_SALT = (np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
#: A shared token as it is sent to its class: its bytes and its rank of rarity.
ENTRY = TOKEN_BITS // 8 + 1
#: Sizes of one band differ by this factor.
BAND = 1.1
#: Bits of a set: the power of two that serves sets of up to some hundreds of tokens; of larger ones they exclude less.
BITS = 512


def _sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and tokens of the distinct shingles, ordered by both; size and class of each row's set."""
    words = words_of(texts, NON_SPACE)
    row, _, value = shingles(words, k)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    n = np.bincount(row, minlength=words.n_rows)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value), out=total[1:])
    ends = np.cumsum(n)
    cls = mix(total[ends] - total[ends - n] + n.astype(np.uint64))
    cls[n == 0] = 0
    return row, value >> np.uint64(64 - TOKEN_BITS), n, cls


def _class_rows(k: int, names: list[str]):
    """The columns before the text, and class and size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, n, cls = _sets(part.column(len(names)), k)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], pa.array(cls.view(np.int64)), pa.array(n, pa.int32())], [*names, "cls", "n"]
                )

    return run


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays in one buffer: the k-th bytes of all values stand together, which compresses well."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out.append(struct.pack("<2sQQ", a.dtype.str[1:].encode(), len(raw), len(small)) + small)
    return b"".join(out)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    at, out = 1, []
    for _ in range(data[0]):
        kind, size, small = struct.unpack_from("<2sQQ", data, at)
        at += 18
        kind = np.dtype("<" + kind.decode())
        raw = pa.decompress(data[at : at + small], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1) if size else np.zeros(0, kind))
        at += small
    return out


def _edges(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def _pieces(token: np.ndarray, cls: np.ndarray, flags: np.ndarray, shift: int, ranges: int, least: int) -> pa.RecordBatch:
    """Rows ``(bucket, data)`` of who holds which tokens, once each: tokens ``>> shift`` are the buckets.

    Hot tokens (of ``least`` classes) go as flags; their holders go to the buckets -1 - (part of the class), for the class directly.
    """
    order = np.argsort(token, kind="stable")
    token, cls = token[order], cls[order]
    del order
    edge = _edges(token)
    count = np.diff(np.append(edge, len(token)))
    hot = np.repeat(count >= least, count)
    flags = np.unique(np.concatenate([flags, token[edge][count >= least]]))
    hot_cls, hot_token, cls, token = cls[hot], token[hot], cls[~hot], token[~hot]
    buckets, data = [], []
    at, flag_at = token >> np.uint64(shift), flags >> np.uint64(shift)
    for b in np.union1d(at, flag_at).tolist():
        begin, end = np.searchsorted(at, [b, b + 1])
        used, who = np.unique(cls[begin:end], return_inverse=True)
        own = flags[slice(*np.searchsorted(flag_at, [b, b + 1]))]
        buckets.append(b)
        data.append(pack_arrays(np.diff(token[begin:end], prepend=np.uint64(0)), who.astype(np.uint32), used, own))
    part = hot_cls % np.uint64(ranges)
    for b in np.unique(part).tolist():
        buckets.append(-1 - b)
        data.append(pack_arrays(hot_cls[part == b], hot_token[part == b]))
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])


def _packs(k: int, shift: int, ranges: int):
    none, hot, stretch = np.zeros(0, np.uint64), HOT, STRETCH

    def flush(held: list[tuple]) -> pa.RecordBatch:
        row, token, n, cls = map(np.concatenate, zip(*held, strict=True))
        _, first = np.unique(cls, return_index=True)
        rep = np.zeros(len(cls), bool)  # one document of each class
        rep[first] = n[first] > 0
        own = rep[row]
        return _pieces(token[own], cls[row[own]], none, shift, ranges, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = rows = 0
        for batch in batches:
            for part in slices(batch, "text"):
                row, token, n, cls = _sets(part.column(0), k)
                held.append(((row + rows).astype(np.int32), token, n, cls))
                rows += len(n)
                size += len(row)
                if size >= stretch:
                    yield flush(held)
                    held, size, rows = [], 0, 0
        if held:
            yield flush(held)

    return run


def _holders(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, their classes, and flags of hot tokens, of pieces."""
    tokens, classes, flags = [], [], []
    for raw in pieces:
        delta, who, used, own = unpack_arrays(raw)
        tokens.append(np.cumsum(delta, dtype=np.uint64))
        classes.append(used[who])
        flags.append(own)
    return np.concatenate(tokens), np.concatenate(classes), np.concatenate(flags)


def _dealt_again(shift: int, ranges: int):
    """Pieces that come in the order of their buckets, in pieces of smaller buckets."""
    hot, stretch = HOT, STRETCH

    def flush(held: list[bytes]) -> pa.RecordBatch:
        token, cls, flags = _holders(held)
        order = np.lexsort((cls, token))
        token, cls = token[order], cls[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        return _pieces(token[new], cls[new], flags, shift, ranges, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, last = 0, None
        for batch in batches:
            for i, (bucket, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                if bucket < 0:
                    yield batch.slice(i, 1)
                    continue
                raw = data.as_py()
                if held and (bucket != last or size > stretch):
                    yield flush(held)
                    held, size = [], 0
                held.append(raw)
                last = bucket
                size += struct.unpack_from("<2sQ", raw, 1)[1] // 8
        if held:
            yield flush(held)

    return run


def _entries(cls: np.ndarray, token: np.ndarray, rank: np.ndarray) -> pa.Table:
    """``cls, part``: the entries of each class."""
    order = np.argsort(cls, kind="stable")
    cls, token, rank = cls[order], token[order], rank[order]
    raw = np.empty((len(cls), ENTRY), np.uint8)
    raw[:, :-1] = token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ENTRY - 1]
    raw[:, -1] = rank
    edge = _edges(cls)
    offsets = np.append(edge, len(cls)).astype(np.int32) * ENTRY
    parts = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
    return pa.table({"cls": pa.array(cls[edge].view(np.int64)), "part": parts})


def _shared(table: pa.Table) -> pa.Table:
    """Of one range of tokens, what at least two classes hold, by class."""
    pieces = [x.as_py() for x in table.column("data")]
    if table.column("bucket")[0].as_py() < 0:
        cls, token = map(np.concatenate, zip(*map(unpack_arrays, pieces), strict=True))
        return _entries(cls, token, np.full(len(cls), 255, np.uint8))
    del table
    token, cls, flags = _holders(pieces)
    del pieces
    order = np.lexsort((cls, token))
    token, cls = token[order], cls[order]
    del order
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls = token[new], cls[new]
    edge = _edges(token)
    count = np.diff(np.append(edge, len(token)))
    rank = np.minimum(count, 254).astype(np.uint8)
    rank[np.isin(token[edge], flags)] = 255
    rank = np.repeat(rank, count)
    keep = rank > 1
    return _entries(cls[keep], token[keep], rank[keep])


NEAR = "cls long, n int, m int, p int, tokens array<long>, " + ", ".join(f"prefix{i} array<long>" for i in range(1, ORDERS)) + ", bits array<long>"


def _bits(token: np.ndarray) -> np.ndarray:
    """Whether an odd number of tokens falls on each bit, as BITS / 64 words."""
    odd = np.bincount((mix(token) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _orders(token: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """The tokens under each order; each is the same for all sets, as ranks and hashes are a token's own."""
    ties = [mix(token ^ salt) for salt in _SALT]
    return [token[np.lexsort((ties[0], rank))], token[np.argsort(ties[1])], token[np.lexsort((ties[2], -rank.astype(np.int16)))]]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def _near(percent: int):
    """Of rows ``(cls, n, part)`` in the order of classes, those classes that can link.

    Their m shared tokens come in the first order, of which the first p are the prefix; then the prefixes under the others.
    """

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        cls = batch.column(0).to_numpy()
        edge = np.append(_edges(cls), len(cls))
        size = np.maximum.reduceat(batch.column(1).fill_null(0).to_numpy().astype(np.int64), edge[:-1])
        parts = batch.column(2).fill_null(b"")
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
        raw = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
        begin, end = offsets[edge[:-1]], offsets[edge[1:]]
        least = -(-percent * size // 100)
        rows: list[tuple] = []
        for i in np.flatnonzero((end - begin) // ENTRY >= np.maximum(least, 1)).tolist():
            entry = raw[begin[i] : end[i]].reshape(-1, ENTRY)
            token = np.zeros((len(entry), 8), np.uint8)
            token[:, : ENTRY - 1] = entry[:, :-1]
            token, first = np.unique(token.view("<u8").reshape(-1), return_index=True)  # a hot token may come twice
            rank, prefix = entry[first, -1], len(token) - int(least[i]) + 1
            if prefix > 0:
                orders = _orders(token, rank)
                rows.append((cls[edge[i]], size[i], len(token), prefix, orders[0], *(x[:prefix] for x in orders[1:]), _bits(token)))
        columns = list(zip(*rows, strict=True)) or [[]] * (5 + ORDERS)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in NEAR.split(", ")]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(np.array(c, np.int64), pa.int64()).cast(t) for c, t in zip(columns, kinds, strict=False)), *map(_lists, columns[4:])], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            at = int(_edges(batch.column(0).to_numpy())[-1])  # the last class may go on
            rest = batch.slice(at)
            if at:
                yield of(batch.slice(0, at))
        if rest is not None:
            yield of(rest)

    return run


def _enough(common: Column, n_a: str, n_b: str, percent: int) -> Column:
    """Whether so many common tokens make a link."""
    return (100 + percent) * common >= percent * (F.col(n_a).cast("long") + F.col(n_b))


def _compared(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``(a, b)`` those that link: prefixes under each order first, whole sets of those that are left.

    Pairs come from a stored table, so where they are few their size is known and they are broadcast instead of shuffling
    the sets.
    """

    def side(name: str, *columns: str | Column) -> DataFrame:
        short = near.select(F.col("cls").alias(name), *columns)
        return short.select(name, *(F.col(c).alias(f"{c}_{name}") for c in short.columns[1:]))

    prefixes = ("n", "m", F.slice("tokens", 1, F.col("p")).alias("prefix0"), *(f"prefix{i}" for i in range(1, ORDERS)))
    joined = pairs.join(side("a", *prefixes), "a").join(side("b", *prefixes), "b")
    least = F.ceil(percent * (F.col("n_a").cast("long") + F.col("n_b")) / (100 + percent))
    for i in range(ORDERS):
        a, b = (F.slice(f"prefix{i}_{x}", 1, F.greatest(F.lit(0), F.col(f"m_{x}") - least + 1).cast("int")) for x in "ab")
        joined = joined.filter(F.arrays_overlap(a, b))
    left = stored(joined.select("a", "b", "n_a", "n_b"))
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return left.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b").filter(_enough(both, "n_a", "n_b", percent)).select("a", "b")


def _postings(near: DataFrame, percent: int) -> DataFrame:
    """A row for each token of the first order's prefix.  ``most``: the largest set that can have enough in common from it on."""
    each = near.select("cls", "n", "m", F.posexplode(F.slice("tokens", 1, F.col("p"))).alias("place", "token"))
    most = F.floor(((100 + percent) * (F.col("m") - F.col("place")).cast("long") - percent * F.col("n")) / percent)
    return each.select("token", "cls", "n", "m", most.alias("most"))


def _mixed(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of tokens that classes of several groups hold, with their groups as ``label``."""
    each = posts.drop("label").join(labels.withColumnRenamed("node", "cls"), "cls")
    mixed = each.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most_label")).filter("least < most_label")
    return each.join(mixed.select("token"), "token")


def _hub_pairs(posts: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each class of a token's list with the list's hub."""
    chance = F.xxhash64("cls", F.lit(turn))
    best = F.struct(F.col("m") / F.col("n"), chance) if turn == 0 else chance
    hub = F.struct(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("m").alias("m_b"), F.col("label").alias("of"))
    hubs = posts.groupBy("token").agg(F.max_by(hub, best).alias("h")).select("token", "h.*")
    return (
        posts.withColumnRenamed("cls", "a")
        .join(hubs, "token")
        .filter((F.col("label") != F.col("of")) & _enough(F.least("m", "m_b"), "n", "n_b", percent))
        .filter(100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
        .select("a", "b")
        .distinct()
    )


def _other_pairs(posts: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """All pairs of different groups that can link, the larger set as ``a``: they meet at a token and a band of sizes.

    ``near`` has the bits that their sets differ in at most.
    """
    posts = posts.join(near.select("cls", "bits"), "cls")

    def band(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / math.log(BAND))

    fewest = F.ceil(percent * F.col("n").cast("long") / 100)
    held = posts.filter("most >= n").select(
        "token", band(F.col("n")).alias("band"), F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("label").alias("label_b"), F.col("most").alias("most_b"),
        F.col("m").alias("m_b"), F.col("bits").alias("bits_b"),
    )
    asked = (
        posts.select("token", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("label").alias("label_a"), F.least("n", "most").alias("most_a"), fewest.alias("fewest"), F.col("m").alias("m_a"), F.col("bits").alias("bits_a"))
        .filter("most_a >= fewest")
        .withColumn("band", F.explode(F.sequence(band(F.col("fewest")), band(F.col("most_a")))))
    )
    each = held.select("token", "band", F.col("label_b").alias("label")).unionByName(asked.select("token", "band", F.col("label_a").alias("label")))
    counts = each.groupBy("token", "band", "label").agg(F.count("*").alias("rows"))
    major = counts.groupBy("token", "band").agg(
        F.max_by("label", F.struct("rows", "label")).alias("major"), F.count("*").alias("groups")
    )
    major = stored(major.filter("groups > 1").drop("groups"))
    held = held.join(major, ["token", "band"]).withColumn("minor_b", F.col("label_b") != F.col("major")).drop("major")
    asked = asked.join(major, ["token", "band"]).withColumn("minor_a", F.col("label_a") != F.col("major")).drop("major")
    differ = sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(BITS // 64)), F.lit(0))
    fits = (
        (F.col("label_a") != F.col("label_b"))
        & (F.struct("n_b", "b") < F.struct(F.col("n_a").alias("n_b"), F.col("a").alias("b")))
        & F.col("n_b").between(F.col("fewest"), F.col("most_a"))
        & (F.col("n_a") <= F.col("most_b"))
        & _enough(F.floor((F.col("m_a") + F.col("m_b") - differ) / 2), "n_a", "n_b", percent)
    )
    rare = asked.filter("minor_a").join(held, ["token", "band"]).filter(fits)
    usual = asked.filter("not minor_a").join(held.filter("minor_b"), ["token", "band"]).filter(fits)
    return rare.select("a", "b").unionByName(usual.select("a", "b")).distinct()


def _links(near: DataFrame, percent: int, hub_rounds: int = 2) -> DataFrame:
    """``node, label``: the group of each class that can link.  Postings shrink from round to round."""
    labels = near.select(F.col("cls").alias("node"), F.col("cls").alias("label"))
    posts = stored(_mixed(_postings(near, percent), labels))
    for turn in range(hub_rounds):
        found = stored(_compared(stored(_hub_pairs(posts, turn, percent)), near, percent))
        if found.isEmpty():
            break
        labels = merge_labels(labels, found)
        posts = stored(_mixed(posts, labels))
    return merge_labels(labels, stored(_compared(stored(_other_pairs(posts, near, percent)), near, percent)))


def _labels(texts: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``node, label`` of the classes that can link; ``texts`` has one column, ``rows`` has class and size of each text."""
    ranges = power_of_two(text_bytes(texts) / 6 / RANGE_TOKENS, LEAST_RANGES)
    bits, step = ranges.bit_length() - 1, FAN.bit_length() - 1
    done = min(bits, step)
    packs = texts.mapInArrow(_packs(k, TOKEN_BITS - done, ranges), "bucket long, data binary")
    while done < bits:
        done = min(bits, done + step)
        packs = packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_dealt_again(TOKEN_BITS - done, ranges), "bucket long, data binary")
    shared = packs.groupBy("bucket").applyInArrow(_shared, "cls long, part binary")
    sizes = rows.filter("n > 0").groupBy("cls").agg(F.max("n").alias("n"))
    each = shared.select("cls", F.lit(None).cast("int").alias("n"), "part").unionByName(sizes.withColumn("part", F.lit(None).cast("binary")))
    near = stored(each.repartition("cls").sortWithinPartitions("cls").mapInArrow(_near(percent), NEAR))
    return _links(near, percent)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row."""
    plain, (key, body) = positional(docs, doc_id, text)
    slim = plain.select(F.col(key).cast("long").alias("doc_id"), F.col(body).cast("string").alias("text"))
    rows = stored(slim.mapInArrow(_class_rows(k, ["doc_id"]), "doc_id long, cls long, n int"))
    labels = _labels(slim.select("text"), rows, k, percent)
    # the smallest doc id of each class, then of each group; both are summed before they are shuffled
    classes = rows.filter("n > 0").groupBy("cls").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"))
    classes = stored(classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("group", F.coalesce("label", "cls")))
    groups = classes.groupBy("group").agg(F.min("least").alias("component"))
    # a class of its own stays out of the join, and adaptive execution splits a class of very many rows
    moved = classes.join(groups, "group").filter("rows > 1 or component < least").select("cls", "component")
    return rows.join(moved, "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group, in the columns of ``docs``; rows without words are in no group and all stay.

    The one with the smallest id stays (rows without an id come last, ties go by a hash of the whole row), so of different
    texts under one id each is judged by its own group, and of equal rows one stays.
    """
    plain, (key, body) = positional(docs, doc_id, text)
    own = row_key(*plain.columns)
    slim = plain.select(*own, F.col(key).cast("long").alias("doc_id"), F.col(body).cast("string").alias("text"))
    names = ["k1", "k2", "doc_id"]
    rows = stored(slim.mapInArrow(_class_rows(k, names), "k1 long, k2 long, doc_id long, cls long, n int"))
    labels = _labels(slim.select("text"), rows, k, percent).withColumnRenamed("node", "cls")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    first = rows.filter("n > 0").groupBy("cls").agg(F.min(place).alias("own"), F.count("*").alias("rows"))
    first = stored(first.join(labels, "cls", "left").withColumn("group", F.coalesce("label", "cls")))
    groups = first.groupBy("group").agg(F.min("own").alias("kept"), F.sum("rows").alias("rows")).filter("rows > 1").drop("rows")
    of = first.join(groups, "group").select("cls", "kept")
    grouped = stored(rows.join(of, "cls").select("k1", "k2", ((F.col("k1") == F.col("kept.k1")) & (F.col("k2") == F.col("kept.k2"))).alias("stays")))
    gone = stored(grouped.filter("not stays").select("k1", "k2").distinct())  # its size is then known
    again = stored(grouped.filter("stays").groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2"))
    kept = plain.withColumns(dict(zip(("k1", "k2"), own, strict=True))).join(gone, ["k1", "k2"], "left_anti")
    if not again.isEmpty():  # equal rows
        once = kept.join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        kept = kept.join(again, ["k1", "k2"], "left_anti").unionByName(once)
    return kept.select(*plain.columns).toDF(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT s.doc_id, s.g FROM s JOIN shared USING (g)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
