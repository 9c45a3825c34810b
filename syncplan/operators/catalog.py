"""Catalog tables and the resolution of names: S10, F14, J11, A9 and A11."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical_field_name, canonical_path, plain_number, trim_white

#: Field definitions that a catalog may hold; more are an error, so they may be broadcast.
MOST_FIELDS = 10_000
#: Names of a catalog that are broadcast, at most.
MOST_NAMES = 100_000

# The destination's field types.
TEXT = ("singlelinetext", "multilinetext", "html", "richcontent", "date", "datetime", "time", "duration")
LISTED = ("classificationlist", "optionlist", "userlist", "usergrouplist", "languagelist")
PASSED = ("recordlist", "recordlink", "textlist")
TYPES = (*TEXT, "numeric", "json", *PASSED, *LISTED, "hyperlinklist")


@dataclass(frozen=True)
class Catalog:
    """fields (id, name, data_type, ordinal), options (field_id, id, name), classifications (id, name_path),
    languages (id, culture, name), users (id, name, email), groups (id, name)."""

    fields: DataFrame
    options: DataFrame | None = None
    classifications: DataFrame | None = None
    languages: DataFrame | None = None
    users: DataFrame | None = None
    groups: DataFrame | None = None

    @classmethod
    def from_tables(cls, spark: SparkSession, path: str) -> Catalog:
        read = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
        return cls(*(read(n) for n in ("fields", "options", "classifications", "languages", "users", "groups")))

    @cached_property
    def names(self) -> DataFrame | None:
        """``names_table``, made and counted once for a catalog: up to MOST_NAMES rows are kept and broadcast."""
        names = names_table(self)
        if names is None:
            return None
        held = names.limit(MOST_NAMES + 1).persist()
        if held.count() <= MOST_NAMES:
            return F.broadcast(held)
        held.unpersist()
        return names

    def checked(self) -> Catalog:
        if self.fields.limit(MOST_FIELDS + 1).count() > MOST_FIELDS:
            raise ValueError(f"more than {MOST_FIELDS} field definitions")
        return self


def _small(names: DataFrame) -> DataFrame:
    """With a broadcast hint if there are at most MOST_NAMES rows, counted here; else Spark joins them as any table."""
    return F.broadcast(names) if names.limit(MOST_NAMES + 1).count() <= MOST_NAMES else names


def field_index(fields: DataFrame) -> DataFrame:
    """``key, field_id, data_type``: of definitions with the same canonical name the last one counts."""
    rows = fields.groupBy(canonical_field_name("name").alias("key")).agg(F.max_by(F.struct("id", "data_type"), "ordinal").alias("d"))
    return rows.select("key", F.col("d.id").alias("field_id"), F.lower("d.data_type").alias("data_type"))


def names_table(catalog: Catalog) -> DataFrame | None:
    """``kind, owner, key, id`` of everything that values name.  Users go by name and email, languages by culture and name."""
    parts = []

    def add(df: DataFrame, kind: str, key: Column, owner: Column | None = None) -> None:
        parts.append(df.select(F.lit(kind).alias("kind"), (owner if owner is not None else F.lit("")).cast("string").alias("owner"), key.alias("key"), F.col("id").cast("string").alias("id")))

    if catalog.options is not None:
        add(catalog.options, "optionlist", canonical_field_name("name"), F.col("field_id"))
    if catalog.classifications is not None:
        add(catalog.classifications, "classificationlist", canonical_path("name_path"))
    if catalog.users is not None:
        add(catalog.users, "userlist", canonical_field_name("name"))
        add(catalog.users, "userlist", canonical_field_name("email"))
    if catalog.groups is not None:
        add(catalog.groups, "usergrouplist", canonical_field_name("name"))
    if catalog.languages is not None:
        add(catalog.languages, "languagelist", canonical_field_name("culture"))
        add(catalog.languages, "languagelist", canonical_field_name("name"))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("key is not null").groupBy("kind", "owner", "key").agg(F.min("id").alias("id"))


def needed_catalogs(usage: DataFrame, fields: DataFrame, default_language: str | None = None) -> DataFrame:
    """``kind``: list types whose catalogs a manifest needs; ``usage`` has ``name`` and ``language``."""
    used = usage.select(canonical_field_name("name").alias("key")).distinct()
    kinds = field_index(fields).join(used, "key", "left_semi").filter(F.col("data_type").isin(*LISTED)).select(F.col("data_type").alias("kind"))
    tagged = usage.filter(F.coalesce("language", F.lit("")) != "").select(F.lit("languagelist").alias("kind")).limit(1)
    out = kinds.unionByName(tagged)
    if default_language:
        out = out.unionByName(usage.sparkSession.createDataFrame([("languagelist",)], "kind string"))
    return out.distinct()


def resolve_fields(entries: DataFrame, catalog: Catalog, default_language: str | None = None) -> DataFrame:
    """One row for each record: ``fields`` to write, or the first ``error`` by position and no fields.

    ``entries``: record, pos, name, value (variant), language.  Entries of one field stay together, each with its
    language and all kept in order; fields come in the order of their first entries.
    """
    fields = F.broadcast(field_index(catalog.checked().fields))
    rows = entries.withColumn("key", canonical_field_name("name")).join(fields, "key", "left")
    kind, typed = F.col("kind"), F.col("data_type")
    rows = rows.withColumn("kind", F.coalesce(F.schema_of_variant("value"), F.lit("VOID")))
    is_text = kind == "STRING"
    text = F.try_variant_get("value", "$", "string")
    items = F.try_variant_get("value", "$", "array<string>")
    # elements that aren't text make the value wrong
    clean = F.coalesce(F.forall(F.coalesce(F.try_variant_get("value", "$", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v) == "STRING"), F.lit(True))
    listed = F.when(is_text, F.array(text)).when(F.startswith(kind, F.lit("ARRAY")) & clean, items)
    links = F.try_variant_get("value", "$", "array<struct<url: string, label: string>>")
    number = plain_number(text)
    as_json = F.when(is_text, F.when(F.try_parse_json(text).isNotNull(), text)).otherwise(F.to_json("value"))
    rows = rows.select(
        "record", "pos", "name", "language", "field_id", "data_type", "kind",
        F.when(typed.isin(*TEXT) & is_text, text).when((typed == "numeric") & (is_text | kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")), F.when(is_text, trim_white(text)).otherwise(number)).when(typed == "json", as_json).alias("value"),
        F.when(typed.isin(*PASSED, *LISTED), listed).alias("names"),
        F.when((typed == "hyperlinklist") & F.startswith(kind, F.lit("ARRAY")) & F.coalesce(F.forall(links, lambda x: F.coalesce(x["url"], F.lit("")) != ""), F.lit(False)), links).alias("links"),
    )
    names = catalog.names
    if names is None:
        names = entries.sparkSession.createDataFrame([], "kind string, owner string, key string, id string")
    # each name of a value is a row until it is resolved; all that is gathered afterwards is gathered by record, in one shuffle
    each = rows.withColumn("listed", F.when(typed.isin(*LISTED), F.col("names"))).select("*", F.posexplode_outer("listed").alias("i", "asked")).drop("listed")
    by_path = typed == "classificationlist"
    each = each.withColumn("key", F.when(by_path, canonical_path("asked")).otherwise(canonical_field_name("asked")))
    each = each.withColumn("owner", F.when(typed == "optionlist", F.col("field_id").cast("string")).otherwise(F.lit("")))
    found = each.join(names.withColumnRenamed("kind", "data_type"), ["data_type", "owner", "key"], "left")
    unknown = F.when(F.col("id").isNull(), F.col("asked"))
    rows = found.repartition("record").groupBy("record", "pos").agg(
        F.first(F.struct("name", "language", "field_id", "data_type", "kind", "value", "names", "links")).alias("row"),
        F.array_sort(F.collect_list(F.when(F.col("asked").isNotNull(), F.struct("i", "id")))).alias("got"),
        F.min_by(unknown, F.when(unknown.isNotNull(), F.col("i"))).alias("unknown"),
    ).select("record", "pos", "row.*", "got", "unknown")
    rows = rows.withColumn("values", F.when(typed.isin(*LISTED), F.coalesce("got.id", F.array().cast("array<string>"))).otherwise(F.col("names")))
    if catalog.languages is not None:
        spoken = catalog.languages.groupBy(canonical_field_name("culture").alias("culture")).agg(F.min(F.col("id").cast("string")).alias("language_id"))
    else:
        spoken = entries.sparkSession.createDataFrame([], "culture string, language_id string")
    tag = F.coalesce(F.nullif(trim_white("language"), F.lit("")), F.lit(default_language).cast("string"))
    rows = rows.withColumn("culture", canonical_field_name(tag)).join(_small(spoken), "culture", "left")
    wrong = F.col("value").isNull() & F.col("values").isNull() & F.col("links").isNull()
    error = (
        F.when(F.col("field_id").isNull(), F.format_string('unknown field "%s"', F.coalesce("name", F.lit(""))))
        .when(F.col("kind") == "VOID", F.format_string('field "%s": the value is missing', F.col("name")))
        .when(~typed.isin(*TYPES), F.format_string('field "%s": unknown type %s', F.col("name"), typed))
        .when(wrong, F.format_string('field "%s": %s does not take this value', F.col("name"), typed))
        .when(F.col("unknown").isNotNull(), F.format_string('field "%s": unknown name "%s"', F.col("name"), F.col("unknown")))
        .when(F.col("culture").isNull(), F.format_string('field "%s": no language and no default', F.col("name")))
        .when(F.col("language_id").isNull(), F.format_string('field "%s": unknown language "%s"', F.col("name"), F.col("culture")))
    )
    rows = rows.withColumn("error", error)
    localized = F.struct("pos", "language_id", "value", "values", "links")
    per_field = rows.groupBy("record", "field_id").agg(
        F.min("pos").alias("first"),
        F.array_sort(F.collect_list(localized), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("localized"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"),
        F.min(F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error_pos"),
    )
    whole = F.struct("first", "field_id", "localized")
    out = per_field.groupBy("record").agg(
        F.array_sort(F.collect_list(whole), lambda a, b: (a["first"] - b["first"]).cast("int")).alias("fields"), F.min_by("error", "error_pos").alias("error")
    )
    return out.select("record", F.when(F.col("error").isNull(), F.col("fields")).alias("fields"), "error")
