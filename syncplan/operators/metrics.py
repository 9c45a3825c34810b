"""Rates and totals of runs: A12 and W4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throughput(batches: DataFrame, *by: str) -> DataFrame:
    """``bytes, records, seconds, records_per_second, bytes_per_second`` of batches (size, records, seconds)."""
    out = batches.groupBy(*by).agg(F.sum("size").alias("bytes"), F.sum("records").alias("records"), F.sum("seconds").alias("seconds"))
    rate = lambda c: F.when(F.col("seconds") > 0, F.col(c) / F.col("seconds")).otherwise(F.lit(0.0))
    return out.withColumn("records_per_second", rate("records")).withColumn("bytes_per_second", rate("bytes"))


def ema(metrics: DataFrame, value: str, tick: str, *by: str, alpha: float = 0.3) -> DataFrame:
    """The exponential moving average after the last tick of each run; the first sample seeds it.

    Ticks are dealt by ranges of (run, tick), so a run of very many ticks is on many tasks.  Each range is folded to what the
    average before it is multiplied with and what is added; these few are then put together in order.  Samples without a
    tick or a value don't count; ties of a tick go by value.
    """
    keep = 1 - alpha
    rows = metrics.select(*by, F.col(tick).alias("_t"), F.col(value).cast("double").alias("_v")).filter("_t is not null and _v is not null")
    ranges = rows.repartitionByRange(*by, "_t", "_v").withColumn("_range", F.spark_partition_id())
    points = ranges.groupBy(*by, "_range").agg(F.array_sort(F.collect_list(F.struct("_t", "_v"))).alias("_points"))
    added = F.aggregate("_points", F.lit(0.0), lambda acc, x: F.lit(alpha) * x["_v"] + F.lit(keep) * acc)
    part = F.struct("_range", F.pow(F.lit(keep), F.size("_points")).alias("decay"), added.alias("added"), F.element_at("_points", 1)["_v"].alias("seed"))
    parts = points.select(*by, part.alias("_part")).groupBy(*by).agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    folded = F.aggregate("_parts", F.element_at("_parts", 1)["seed"], lambda acc, x: x["decay"] * acc + x["added"])
    return parts.select(*by, folded.alias("ema"))
