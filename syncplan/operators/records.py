"""Applying plans to record tables: K5, K6, K7, W3, J15."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import BUCKETS, BucketStore
from .manifest import is_record_id

CHUNK = 1000


@dataclass(frozen=True)
class Records:
    """records (record_id, status, updated), files (record_id, file_id, is_master), versions (record_id, file_id,
    version, path, hash, size), fields (record_id, field_id, localized)."""

    records: DataFrame
    files: DataFrame
    versions: DataFrame
    fields: DataFrame


def resolve_master_files(lines: DataFrame, files: DataFrame, id: str = "id") -> DataFrame:
    """Adds ``master_file_id``; malformed ids and records without a master file have none."""
    masters = files.filter("is_master").groupBy(F.col("record_id").alias(id)).agg(F.min("file_id").alias("master_file_id"))
    return lines.join(masters, id, "left").withColumn("master_file_id", F.when(is_record_id(id), F.col("master_file_id")))


def record_id() -> Column:
    """The id of a plan's record: the one that it names, or one made of the plan's."""
    return F.coalesce(F.nullif("dest_id", F.lit("")), F.substring(F.sha2(F.col("plan_id").cast("string"), 256), 1, 32))


def apply_plan(plan: DataFrame, tables: Records, now: datetime.datetime) -> Records:
    """The tables after a plan (plan_id, dest_id, path, hash, size, status, fields); ``path`` is null for a patch.

    No record id: a record is created, with an id made of the plan's.  A path: a new version of the master file, or of a
    new file where there is none.  Fields replace those of the same id.  A patch with no fields and no status does nothing.
    At most one row a record; the last plan id counts.
    """
    rows = plan.withColumn("record_id", record_id())
    rows = rows.filter(F.col("path").isNotNull() | (F.coalesce("status", F.lit("")) != "") | (F.size(F.coalesce("fields", F.array().cast(plan.schema["fields"].dataType))) > 0))
    rest = [c for c in rows.columns if c != "record_id"]
    rows = rows.groupBy("record_id").agg(F.max_by(F.struct(*rest), "plan_id").alias("p")).select("record_id", "p.*")
    changed = rows.select("record_id", F.col("status").alias("_status"), F.lit(now).alias("_now"))
    records = tables.records.join(changed, "record_id", "full_outer").select(
        "record_id", F.coalesce(F.nullif("_status", F.lit("")), "status", F.lit("draft")).alias("status"), F.coalesce("_now", F.col("updated").cast("timestamp")).alias("updated")
    )
    sent = resolve_master_files(rows.filter("path is not null").withColumnRenamed("record_id", "id"), tables.files).withColumnRenamed("id", "record_id")
    sent = sent.withColumn("file_id", F.coalesce("master_file_id", F.concat(F.lit("f"), F.substring(F.sha2(F.concat("record_id", F.lit("/"), F.col("plan_id").cast("string")), 256), 1, 31))))
    new_files = sent.filter("master_file_id is null").select("record_id", "file_id", F.lit(True).alias("is_master"))
    last = tables.versions.groupBy("file_id").agg(F.max("version").alias("_last"))
    new_versions = sent.join(last, "file_id", "left").select(
        "record_id", "file_id", (F.coalesce("_last", F.lit(0)) + 1).cast(tables.versions.schema["version"].dataType).alias("version"), "path", "hash", "size"
    )
    new_fields = rows.select("record_id", F.explode("fields").alias("f")).select("record_id", F.col("f.field_id").alias("field_id"), F.col("f.localized").alias("localized"))
    kept = tables.fields.join(new_fields.select("record_id", "field_id"), ["record_id", "field_id"], "left_anti")
    return Records(records, tables.files.unionByName(new_files), tables.versions.unionByName(new_versions), kept.unionByName(new_fields))


TABLES = {
    "records": "record_id string, status string, updated timestamp",
    "files": "record_id string, file_id string, is_master boolean",
    "versions": "record_id string, file_id string, version int, path string, hash string, size long",
    "fields": "record_id string, field_id string, localized array<struct<language_id: string, value: string>>",
}


class RecordStore:
    """Record tables that are stored in buckets of record ids; a plan rewrites the buckets of its records and no others.

    All four tables change at once, behind one pointer.  ``schemas`` are TABLES unless others are given.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str] | None = None, buckets: int = BUCKETS):
        self.schemas = TABLES | (schemas or {})
        self.store = BucketStore(spark, path, dict.fromkeys(self.schemas, "record_id"), buckets)

    def read(self, only: Iterable[int] | None = None) -> Records:
        """The tables, or the rows of some buckets."""
        return Records(**{t: self.store.read(t, schema, only) for t, schema in self.schemas.items()})

    def put(self, tables: Records, only: Iterable[int] | None = None) -> int:
        """Replaces all buckets, or some."""
        wanted = list(range(self.store.buckets) if only is None else only)
        columns = {t: self.store.spark.createDataFrame([], schema).columns for t, schema in self.schemas.items()}
        return self.store.commit(*(self.store.stage(t, getattr(tables, t).select(*columns[t]), wanted) for t in self.schemas))

    def apply(self, plan: DataFrame, now: datetime.datetime) -> list[int]:
        """Applies a plan (see ``apply_plan``) and returns the buckets that it touched."""
        met = self.store.touched(plan.select(record_id().alias("record_id")), "record_id")
        if met:
            self.put(apply_plan(plan, self.read(met), now), met)
        return met


def chunked(ids: DataFrame, id: str = "dest_id", chunk: int = CHUNK) -> DataFrame:
    """Adds ``chunk``: ids in ascending order, so many in each.

    Ids are first dealt to ranges; ranges are numbered by the rows before them, so no task sees all ids.
    """
    spark = ids.sparkSession
    dealt = ids.select(id).distinct()
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionByRange(n, id).withColumn("_part", F.spark_partition_id())
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = dealt.join(counts, "_part").withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(id)) + F.col("_before"))
    return ranked.select(id, F.floor((F.col("_rank") - 1) / chunk).alias("chunk"))


def file_into_collection(created: DataFrame, members: DataFrame, collection: str, chunk: int = CHUNK) -> DataFrame:
    """New members (collection, dest_id, chunk): records that aren't members yet, in chunks."""
    have = members.filter(F.col("collection") == collection).select("dest_id")
    return chunked(created.join(have, "dest_id", "left_anti"), "dest_id", chunk).withColumn("collection", F.lit(collection))
