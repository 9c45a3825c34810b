"""Ledgers of bulk loads: S9, K4, A6, A7, A10, J14, U2 and O6."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import LEDGER
from ..sources.store import read_text, replace_text
from .manifest import DONE

MARKERS = ("uploaded", "filed")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ledger; a torn line is left out.

    Sorting by the struct ``seq`` gives the order of writing: runs of ``append_ledger`` in turn and the rows of a run in theirs.
    Rows that others wrote come before them, by the time of their file and their place in it.
    """
    raw = spark.read.schema(f"{LEDGER}, run long, at long, _torn string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").json(path)
    seq = F.struct(
        F.coalesce("run", F.lit(0)).alias("run"),
        F.coalesce("at", F.lit(0)).alias("at"),
        F.col("_metadata.file_modification_time").alias("written"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),  # within a block, a task reads it in order
    )
    return raw.filter("_torn is null and action is not null").withColumn("seq", seq).drop("run", "at", "_torn")


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds rows, in their order, as the ledger's next run.  A ledger has one writer at a time.

    The number of the last run lies in a small file beside the rows, which readers pass over, and is taken before rows are
    written; only of a ledger without that file all rows are read.
    """
    spark, pointer = rows.sparkSession, f"{path.rstrip('/')}/_run"
    last = read_text(spark, pointer)
    if last is None:
        try:
            last = spark.read.schema("run long").json(path).agg(F.max("run")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    run = int(last or 0) + 1
    replace_text(spark, pointer, str(run))
    rows.withColumns({"run": F.lit(run).cast("long"), "at": F.monotonically_increasing_id()}).write.mode("append").json(path)


def ledger_state(ledger: DataFrame) -> DataFrame:
    """``hash, done, token``: whether a line is done, and the last upload token of those that aren't."""
    uploaded = F.col("action") == "uploaded"
    folded = ledger.filter(F.col("hash").isNotNull()).groupBy("hash").agg(
        F.bool_or(F.col("action").isin(*DONE)).alias("done"),
        F.max_by(F.when(uploaded, F.col("token")), F.when(uploaded, F.col("seq"))).alias("token"),
    )
    return folded.withColumn("token", F.when(~F.col("done"), F.col("token")))


def unfiled(ledger: DataFrame) -> DataFrame:
    """``dest_id``: created records that no ``filed`` row names."""
    created = ledger.filter((F.col("action") == "created") & (F.coalesce("dest_id", F.lit("")) != "")).select("dest_id").distinct()
    filed = ledger.filter(F.col("action") == "filed").select(F.explode("filed").alias("dest_id"))
    return created.join(filed, "dest_id", "left_anti")


def to_file(ledger: DataFrame, created: DataFrame) -> DataFrame:
    """Unfiled records of earlier runs and those created now, each once."""
    return unfiled(ledger).unionByName(created.select("dest_id")).dropDuplicates(["dest_id"])


def _tallies() -> list[Column]:
    """Aggregates of outcome rows; marker rows don't count."""
    counts = ~F.col("action").isin(*MARKERS)
    of = lambda a, name=None: F.count_if(counts & (F.col("action") == a)).alias(name or a)
    names = ("created", "updated", "metadata", "valid", "invalid", "skipped")
    return [*map(of, names), of("error", "failed"), F.count_if(counts & (F.coalesce("warn", F.lit("")) != "")).alias("rewritten"), F.count_if(counts).alias("_all")]


def import_summary(results: DataFrame, total: int | None = None) -> DataFrame:
    """One row of tallies; marker rows don't count.  ``aborted`` is what ``total`` lines leave."""
    out = results.agg(*_tallies())
    return out.withColumn("aborted", F.greatest(F.lit(0), F.lit(total) - F.col("_all")) if total is not None else F.lit(0)).drop("_all")


def append_measured(rows: DataFrame, path: str, total: int | None = None, size: str | None = None) -> dict[str, int | float]:
    """``append_ledger``, and ``import_summary`` of what it wrote, taken by the writing job itself.

    Beside the tallies: ``rows`` written with markers, ``seconds``, ``records_per_second``, and with a ``size`` column
    ``bytes`` and ``bytes_per_second``.  Spark counts a task that ran twice once.
    """
    seen, began = Observation("ledger"), time.monotonic()
    measures = [*_tallies(), F.count(F.lit(1)).alias("rows")] + ([F.coalesce(F.sum(size), F.lit(0)).alias("bytes")] if size else [])
    if "warn" not in rows.columns:
        rows = rows.withColumn("warn", F.lit(None).cast("string"))
    append_ledger(rows.observe(seen, *measures), path)
    got, seconds = dict(seen.get), time.monotonic() - began
    records = got.pop("_all")
    got |= {"aborted": max(0, total - records) if total is not None else 0, "seconds": seconds, "records_per_second": records / seconds}
    return got | ({"bytes_per_second": got["bytes"] / seconds} if size else {})


def problems(results: DataFrame, n: int = 100) -> DataFrame:
    """``line, reason`` of the first n lines in error, by line."""
    return results.filter("error is not null").select("line", F.col("error").alias("reason")).orderBy("line", "reason").limit(n)
