"""The sync log: A1, W1, W2, K2, K3, K8, F12, A3, O2 and O5."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import directory, stem


_KEYS = ("channel_name", "source_path")


def latest(log: DataFrame, *keys: str, order: str = "id") -> DataFrame:
    """The row with the largest id of each key (channel and path by default).  One aggregation, no self-join."""
    keys = keys or _KEYS
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*").select(*log.columns)


def version_history(log: DataFrame) -> DataFrame:
    """Each row with its path's version and record before it, its number, and the kind that follows from a prior record."""
    w = Window.partitionBy(*_KEYS).orderBy("id")
    out = log.select("id", *_KEYS, "source_version", "dest_id")
    return (
        out.withColumn("seq", F.row_number().over(w))
        .withColumn("previous_version", F.lag("source_version").over(w))
        .withColumn("derived_kind", F.when(F.lag("dest_id").over(w).isNull(), "create").otherwise("update"))
    )


def with_stem(rows: DataFrame, path: str = "source_path") -> DataFrame:
    return rows.withColumn("source_stem", stem(path)).withColumn("source_dir", directory(path))


def new_log_rows(log: DataFrame, written: DataFrame, now: datetime.datetime, idempotent: bool = False) -> DataFrame:
    """Log rows for successful writes: stem, directory, time and ids after the log's last one.

    idempotent: a write is left out whose version and record are those of the latest row of its channel and path.
    Ids need not be dense; they ascend with (channel, path, version).
    """
    rows = written
    if idempotent:
        last = latest(log).select(*_KEYS, F.col("source_version").alias("_version"), F.col("dest_id").alias("_dest"))
        rows = rows.join(last, list(_KEYS), "left")
        same = F.col("_version").eqNullSafe(F.col("source_version")) & F.col("_dest").eqNullSafe(F.col("dest_id"))
        rows = rows.filter(~F.coalesce(same & F.col("_dest").isNotNull(), F.lit(False))).drop("_version", "_dest")
    top = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    ordered = rows.repartitionByRange(F.col("channel_name"), F.col("source_path"), F.col("source_version")).sortWithinPartitions(
        "channel_name", "source_path", "source_version"
    )
    out = with_stem(ordered).withColumn("id", F.lit(top + 1) + F.monotonically_increasing_id()).withColumn("ts", F.lit(now))
    missing = [c for c in log.columns if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast(log.schema[c].dataType) for c in missing}).select(*log.columns)


def append_sync_log(
    log_path: str, log: DataFrame, written: DataFrame, now: datetime.datetime, idempotent: bool = True, period: str = "yyyy-MM"
) -> None:
    """Appends to a log partitioned by ``period`` (of rows' times).  One batch has one time, so it goes to one partition."""
    rows = new_log_rows(log, written, now, idempotent).withColumn("period", F.date_format("ts", period))
    rows.write.mode("append").partitionBy("period").parquet(log_path)


def older_than(log: DataFrame, threshold: Column | datetime.datetime) -> DataFrame:
    return log.filter(F.col("ts") < (threshold if isinstance(threshold, Column) else F.lit(threshold)))


def archive_older_than(log: DataFrame, threshold: datetime.datetime, out: str | None = None) -> DataFrame:
    """Writes rows before the threshold as JSON lines in the order of ids (nulls left out) and returns the others.

    Without ``out`` old rows are discarded.
    """
    if out is not None:
        older_than(log, threshold).orderBy("id").write.json(out)
    return log.filter(~(F.coalesce(F.col("ts") < F.lit(threshold), F.lit(False))))


def counts_by_channel(log: DataFrame) -> DataFrame:
    return log.groupBy("channel_name").agg(F.count("*").alias("n")).orderBy("channel_name")
