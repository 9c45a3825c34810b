"""What the operators of this subpackage share: tables in the shared folder, row keys and heavy hitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import shared_dir


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read from there: it cuts lineage and outlives executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_caches: dict[str, dict] = {}


def cache_of(task: str) -> dict:
    """This worker process's cache for one kind of task.

    A worker serves stage after stage, so the caches of other kinds are emptied here.
    """
    for other, cache in _caches.items():
        if other != task:
            cache.clear()
    return _caches.setdefault(task, {})


def field(name: str) -> Column:
    """The top-level column of that name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The table with its columns named ``c0``, ``c1`` and so on, and what those of the given names are called there.

    Spark reads dots and back-ticks in names as syntax, and takes names that differ in case as one; here none matters.  A
    name is looked for as it is and then in any case.  ``toDF`` with the old names undoes it.
    """

    def find(name: str) -> str:
        found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"the table has {len(found) or 'no'} columns of name {name!r}")
        return f"c{found[0]}"

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [find(n) for n in names]


def with_length(changed: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Rows in the columns of ``positional(docs)`` whose text was changed, with ``n_chars``, if there is one, as its length."""
    at = [f"c{i}" for i, c in enumerate(docs.columns) if c == "n_chars"]
    return changed.withColumns({c: F.length(text).cast(changed.schema[c].dataType) for c in at})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of the columns; rows that agree in them are the same row, nulls included."""
    given = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]
    return [F.xxhash64(*given).alias("k1"), F.xxhash64(F.lit(7), *given[::-1]).alias("k2")]


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where ``docs`` has such columns."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def null_first(name: str) -> Column:
    """The column as text that isn't null: equal where it is equal, and in its order by code point, null first."""
    return F.coalesce(F.concat(F.lit("="), field(name).cast("string")), F.lit(""))


def ranked(rows: DataFrame, by: list[str], order: list[str], rank: str, among: str = "") -> DataFrame:
    """Adds the position, from 0, of each row among those that have the same ``by`` (no nulls there), in ascending ``order``,
    and, if ``among`` is named, their number.

    Rows are dealt out by ranges, equal ones by where they stand, so neither a frequent ``by`` nor many equal rows meet in
    one task; only the rows of a range are sorted together, and one row a range and ``by`` is summed up.  The result lies in
    the shared folder.
    """
    keys = [field(c).asc_nulls_first() for c in (*by, *order)]
    dealt = rows.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    ranges = dealt.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = dealt.join(stored(ranges.withColumn("_all", F.sum("_n").over(Window.partitionBy(*by))).drop("_n")), [*by, "_range"])
    position = (F.col("_before") + F.col("_at") - F.col("_first")).alias(rank)
    return placed.select(*rows.columns, position, *([F.col("_all").alias(among)] if among else []))


def power_of_two(n: float, least: int = 1) -> int:
    """The smallest power of two of at least n and ``least``."""
    out = least
    while out < n:
        out *= 2
    return out


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; it sizes later partitions."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
