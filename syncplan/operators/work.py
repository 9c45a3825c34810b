"""Items of work: F13, A4, O1, T7, T8 and X20's table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import backoff_seconds, http_category, retryable, truncate_error
from ..schemas import STATUSES


def due_items(work: DataFrame, now: datetime.datetime) -> DataFrame:
    """Pending items whose time has come, the earliest first."""
    return work.filter((F.col("status") == "pending") & (F.col("next_run_at") <= F.lit(now))).orderBy("next_run_at", "id")


def counts_by_status(work: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Every status, also those with no items."""
    names = work.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return names.join(work.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by_stage(markers: DataFrame) -> DataFrame:
    """In-flight items by stage; a missing stage is ``unknown``."""
    return markers.groupBy(F.coalesce("stage", F.lit("unknown")).alias("stage")).agg(F.count("*").alias("n"))


def status_report(work: DataFrame, log: DataFrame) -> DataFrame:
    """``section, name, n``: work by status, and the log by channel."""
    a = counts_by_status(work).select(F.lit("work").alias("section"), F.col("status").alias("name"), "n")
    b = log.groupBy("channel_name").agg(F.count("*").alias("n")).select(F.lit("log").alias("section"), F.col("channel_name").alias("name"), "n")
    return a.unionByName(b).orderBy("section", "name")


def classify_outcomes(outcomes: DataFrame) -> DataFrame:
    """Adds ``category`` and ``retryable`` from ``status`` and ``verb``."""
    return outcomes.withColumn("category", http_category("status")).withColumn("retryable", retryable("status", "verb"))


def apply_outcomes(
    work: DataFrame, outcomes: DataFrame, now: datetime.datetime, max_attempts: int = 5, base: float = 2.0, jitter: float = 0.25
) -> DataFrame:
    """The work table after outcomes (id, ok, error): a success removes its item; a failure waits longer, then is failed."""
    joined = work.join(outcomes.select("id", F.col("ok").alias("_ok"), F.col("error").alias("_error")), "id", "left")
    joined = joined.filter(~F.coalesce(F.col("_ok"), F.lit(False)))
    failed = F.col("_ok").isNotNull()
    attempts = F.coalesce("attempts", F.lit(0)) + 1
    spent = attempts >= max_attempts
    wait = backoff_seconds(attempts, base, jitter=jitter, key="id")
    later = F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) + (wait * 1_000_000).cast("long"))
    later = later.cast(work.schema["next_run_at"].dataType)
    return joined.select(
        *(
            {
                "attempts": F.when(failed, attempts).otherwise(F.col("attempts")).cast(work.schema["attempts"].dataType),
                "status": F.when(failed, F.when(spent, "failed").otherwise("pending")).otherwise(F.col("status")),
                "next_run_at": F.when(failed & ~spent, later).otherwise(F.col("next_run_at")),
                "last_error": F.when(failed, truncate_error("_error")).otherwise(F.col("last_error")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in work.columns
        )
    )


def requeue(work: DataFrame, now: datetime.datetime, id: int | None = None, channel: str | None = None, all: bool = False) -> DataFrame:
    """Failed items become pending again, with no attempts and no error, due now: one by id, a channel's, or all."""
    if (id is not None) + (channel is not None) + bool(all) != 1:
        raise ValueError("give exactly one of id, channel and all")
    if id is not None and work.filter(F.col("id") == id).isEmpty():
        raise ValueError(f"no work item {id}")
    chosen = F.col("status") == "failed"
    if id is not None:
        chosen &= F.col("id") == id
    if channel is not None:
        chosen &= F.col("channel_name") == channel
    fresh = {
        "status": F.lit("pending"),
        "attempts": F.lit(0).cast(work.schema["attempts"].dataType),
        "last_error": F.lit(None).cast("string"),
        "next_run_at": F.lit(now).cast(work.schema["next_run_at"].dataType),
    }
    return work.select(*((F.when(chosen, fresh[c]).otherwise(F.col(c)) if c in fresh else F.col(c)).alias(c) for c in work.columns))
