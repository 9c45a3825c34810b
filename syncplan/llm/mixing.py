"""Mixing sources to target weights: capped water-filling, and seeded whole and fractional repetitions.

A mix of so many words is shared among sources by weight.  A source is used ``epochs`` times at most, so the targets of
sources that would get more are clamped there and what is left goes to the others by weight, until none is above.  The
level (words a unit of weight) is found with whole numbers, so targets don't depend on the order of rows; each round is one
sum over the table of sources, which stays in Spark.

A target is a number of whole repetitions and a rest of less than one.  The rest goes to the documents of a source in the
order of a seeded hash of their ids: those below the source's cut are taken once more, the one at the cut in part (its
first words).  Cuts are found digit by digit, by sums of hashes with the same first digits, so no source's documents are
ever sorted together, however many it has.

Nulls and odd input: a null text has no words; a null source is a source of its own, an empty one another; a null id is
hashed as an empty one; rows of one source and id share what their id gets, each by its size; sources without words get a
target of 0; an empty table gives no rows.  Other columns stay, whatever their names; the new column is named ``mix``, with
underscores behind it where the table has such a column.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, null_first, positional, ranked, read_table, stored

SEED = 42
#: Share of all words that the mix has, and how often a document is used at most.
SHARE, EPOCHS = Fraction(3, 2), 2
#: Weights of the query's sources in the order of their names, from the first on again.
WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of a hash by which cuts are narrowed down; the last are all that it has.
_DIGITS = (2, 5, 16)
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column, seed: int) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, _DIGITS[-1])


def _whole(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(str(x))).cast("decimal(38,0)")


def _div(x: Column, y: Column) -> Column:
    """Whole division of whole decimals, exact."""
    return ((x - x % y) / y).cast("long")


def water_fill(sources: DataFrame, share: Fraction = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` (double) and ``words`` (it, rounded) to a table of ``size`` and ``weight`` (whole numbers, 0 or more).

    Targets sum up to ``share`` of all sizes, or to ``epochs`` times them where that is less.
    """
    size, weight, cap = _whole(F.col("size")), _whole(F.col("weight")), _whole(F.col("size")) * epochs
    total = sources.agg(F.sum(size), F.sum(weight)).first()
    mixed, level, clamped = Fraction(int(total[0] or 0)) * share, Fraction(0), -1
    left, weights = mixed, int(total[1] or 0)
    while weights:
        level = left / weights
        above = cap * _whole(level.denominator) <= weight * _whole(level.numerator)
        found = sources.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, weight))).first()
        if found[0] == clamped:  # no more are above than before
            break
        clamped, left, weights = found[0], mixed - int(found[1] or 0), int(found[2] or 0)
    above = cap * _whole(level.denominator) <= weight * _whole(level.numerator)
    share_of = weight * _whole(level.numerator)
    target = F.when(above, cap.cast("double")).otherwise(share_of.cast("double") / F.lit(float(level.denominator)))
    rounded = _div(share_of * 2 + _whole(level.denominator), _whole(2 * level.denominator))
    words = F.when(above, cap.cast("long")).otherwise(rounded)
    return sources.withColumn("target", target).withColumn("words", words)


def _cuts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``key, cut, part, at_cut``: hashes below the cut are taken, and of the words at it (``at_cut``) a part.

    ``docs`` has key, hash and size; ``plan`` has key and the words to be taken (``rest``), fewer than the key's.
    """
    wanted = plan.filter("rest > 0").select("key", "rest")
    for digits in _DIGITS:
        groups = docs.groupBy("key", F.substring("hash", 1, digits).alias("cut")).agg(F.sum("size").alias("at_cut"))
        end = F.sum("at_cut").over(Window.partitionBy("key").orderBy("cut"))
        before = F.col("_end") - F.col("at_cut")
        met = groups.withColumn("_end", end).join(wanted, "key").filter((before <= F.col("rest")) & (F.col("rest") < F.col("_end")))
        met = stored(met.select("key", "cut", "at_cut", (F.col("rest") - before).alias("rest")))
        wanted = met.select("key", "rest")
        if digits != _DIGITS[-1]:
            own = met.select("key", "cut")
            docs = stored(docs.join(own, "key").filter(F.startswith("hash", F.col("cut"))).drop("cut"))
    return met.withColumnRenamed("rest", "part")


def mix(
    docs: DataFrame,
    weights: DataFrame,
    share: Fraction = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The columns of ``docs`` and a struct: the document's ``size``, its source's ``source_size`` and ``target``, and how
    often it is taken: ``repeats`` times as a whole, and ``part_words`` of its words once more.

    ``weights`` has ``source`` and a whole number ``weight``; sources that it doesn't name have none and get no words.
    """
    rows, (key, body, of) = positional(docs, doc_id, text, source)
    rows = rows.withColumns({"key": null_first(of), "hash": _hash(F.col(key), seed), "n": n_words(F.col(body))})
    slim = stored(rows.select("key", "hash", F.col("n").alias("size")))
    own = weights.groupBy(null_first("source").alias("key")).agg(F.max(F.col("weight").cast("long")).alias("weight"))
    sizes = slim.groupBy("key").agg(F.sum("size").alias("size"))
    plan = water_fill(stored(sizes.join(own, "key", "left").fillna(0, ["weight"])), share, epochs)
    whole = F.when(F.col("size") > 0, _div(_whole(F.col("words")), _whole(F.col("size")))).otherwise(0)
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("words") - F.col("whole") * F.col("size"))
    plan = stored(plan.withColumnRenamed("size", "source_size"))
    plan = stored(plan.join(_cuts(slim, plan), "key", "left"))  # a row a source: broadcast where it is small
    repeats = F.col("whole") + F.when(F.col("hash") < F.col("cut"), 1).otherwise(0)
    part = F.when(F.col("hash") == F.col("cut"), _div(_whole(F.col("n")) * _whole(F.col("part")), _whole(F.col("at_cut")))).otherwise(0)
    struct = F.struct(
        F.col("n").alias("size"), "source_size", "target", repeats.cast("long").alias("repeats"), part.cast("long").alias("part_words")
    )
    given = rows.columns[: len(docs.columns)]
    return rows.join(plan, "key").select(*given, struct).toDF(*docs.columns, *fresh(docs, "mix"))


def repeated(mixed: DataFrame, text: str = "text", mix: str = "mix") -> DataFrame:
    """The mix itself: a row for each repetition of a document, ``repetition`` from 1; one in part has its text's first words."""
    rows, (body, made) = positional(mixed, text, mix)
    times = F.col(made)["repeats"] + (F.col(made)["part_words"] > 0).cast("long")
    rows = rows.filter(times > 0).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    words = F.regexp_extract_all(F.col(body), F.lit(rf"[\x20\x09-\x0D]*{_WORD}"), F.lit(0))
    first = F.array_join(F.slice(words, F.lit(1), F.col(made)["part_words"].cast("int")), "")
    cut = F.when(F.col("number") > F.col(made)["repeats"], first).otherwise(F.col(body))
    return rows.withColumn(body, cut).toDF(*mixed.columns, *fresh(mixed, "repetition"))


def cycled_weights(docs: DataFrame, cycle: tuple[int, ...] = WEIGHTS, source: str = "source") -> DataFrame:
    """Sources by code point, null last, with the weights of the cycle in turn."""
    rows, (name,) = positional(docs, source)
    names = rows.select(F.col(name).cast("string").alias("source")).distinct().withColumn("_last", F.col("source").isNull())
    at = ranked(names, [], ["_last", "source"], "rank")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))
    return at.select("source", weight.alias("weight"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    taken = F.col("mix.repeats") * F.col("mix.size") + F.col("mix.part_words")
    return mix(docs, cycled_weights(docs)).select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"))


#: For the rows of the query: the level by sorting sources by cap over weight, cuts by sums over sorted hashes.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS HUGEINT) AS size,
  substring(sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 16) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS i, 3 * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w FROM s),
k AS (SELECT *, CAST(total - 4 * coalesce(sum(source_size) OVER p, 0) AS HUGEINT) AS a, CAST(2 * (all_w - coalesce(sum(w) OVER p, 0)) AS HUGEINT) AS b
  FROM o WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT min(i) AS i, arg_min(a, i) AS a, arg_min(b, i) AS b FROM k WHERE w * a < 2 * source_size * b),
t AS (SELECT s.source, s.source_size, CASE WHEN f.i IS NULL OR k.i < f.i THEN CAST(2 * s.source_size AS DOUBLE) ELSE CAST(s.w * f.a AS DOUBLE) / CAST(f.b AS DOUBLE) END AS target,
  CASE WHEN f.i IS NULL OR k.i < f.i THEN 2 * s.source_size ELSE (2 * s.w * f.a + f.b) // (2 * f.b) END AS words
  FROM s JOIN k ON k.source IS NOT DISTINCT FROM s.source CROSS JOIN first f),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY source, h) AS at_h FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
 CAST(CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + CASE WHEN upto <= words % source_size THEN size WHEN upto - at_h <= words % source_size THEN size * (words % source_size - upto + at_h) // at_h ELSE 0 END END AS BIGINT) AS taken
FROM c JOIN t ON t.source IS NOT DISTINCT FROM c.source"""
