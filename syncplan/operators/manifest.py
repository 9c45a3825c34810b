"""Bulk-load manifests: S6, S8, F8 to F11, A8, J12, J13, X4, X5 and X8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import rename_warning
from ..functions.values import canonical_field_name, line_hash, trim_white

#: Bytes of one line, at most.
LINE_BYTES = 16 << 20
# Fixed values.
KEYS = ("id", "file", "status", "fields")
ENTRY_KEYS = ("name", "value", "language")
RECORD_STATUSES = ("draft", "released", "archived")
DONE = ("created", "updated", "metadata")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``line`` (from 1, blank lines counted), ``raw`` and ``hash`` of the lines that aren't blank.

    Lines are numbered within each block of a file and blocks by the lines before them, so no task sees a whole file.
    """
    rows = spark.read.text(path).select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    blocks = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = rows.join(blocks, ["_file", "_block"]).withColumn("line", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    out = out.filter(trim_white("raw") != "")
    return out.select("line", "raw", line_hash("raw").alias("hash"))


def parse_manifest(manifest: DataFrame) -> DataFrame:
    """Adds ``doc`` (variant, null if the line is no JSON object), ``id, file, status`` and ``entries`` (array of variants)."""
    # within brackets a line that goes on after its object is no longer one element
    alone = F.try_parse_json(F.concat(F.lit("["), F.col("raw"), F.lit("]")))
    doc = F.when(F.size(F.try_variant_get(alone, "$", "array<variant>")) == 1, F.try_variant_get(alone, "$[0]", "variant"))
    rows = manifest.withColumn("doc", F.when(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), doc))
    text = lambda key: F.coalesce(trim_white(F.try_variant_get("doc", f"$.{key}", "string")), F.lit(""))
    return rows.select(
        *rows.columns,
        text("id").alias("id"),
        text("file").alias("file"),
        F.lower(text("status")).alias("status"),
        F.try_variant_get("doc", "$.fields", "array<variant>").alias("entries"),
    )


def is_record_id(id: Column | str) -> Column:
    return F.coalesce((F.col(id) if isinstance(id, str) else id).rlike(r"\A[0-9A-Za-z]+\z"), F.lit(False))


def _unknown_keys(json: Column, known: tuple[str, ...]) -> Column:
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, known)))


def structure_error(parsed: DataFrame) -> DataFrame:
    """Adds ``error``: why the line can't be used, or null."""
    strange = _unknown_keys(F.col("raw"), KEYS)
    entries = F.coalesce(F.col("entries"), F.array().cast("array<variant>"))
    strange_entry = F.flatten(F.transform(entries, lambda e: _unknown_keys(F.to_json(e), ENTRY_KEYS)))
    nameless = F.exists(entries, lambda e: F.coalesce(trim_white(F.try_variant_get(e, "$.name", "string")), F.lit("")) == "")
    error = (
        F.when(F.octet_length("raw") > LINE_BYTES, "the line is too long")
        .when(F.col("doc").isNull(), "not a JSON object")
        .when(F.size(strange) > 0, F.format_string('unknown key "%s": field values go under "fields"', F.try_element_at(strange, F.lit(1))))
        .when(F.size(strange_entry) > 0, F.format_string('unknown key "%s" in a field entry', F.try_element_at(strange_entry, F.lit(1))))
        .when((F.col("id") == "") & (F.col("file") == ""), "needs an id or a file")
        .when((F.col("id") != "") & ~is_record_id("id"), "the id is malformed")
        .when((F.col("status") != "") & ~F.col("status").isin(*RECORD_STATUSES), F.format_string('unknown status "%s"', F.col("status")))
        .when(nameless, "a field entry has no name")
    )
    return parsed.withColumn("error", error)


def action() -> Column:
    """updated (id and file), metadata (id alone) or created (file alone)."""
    return F.when((F.col("id") != "") & (F.col("file") != ""), "updated").when(F.col("id") != "", "metadata").otherwise("created")


def resume_manifest(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``skipped`` (done before) and ``token`` (uploaded before, not done) from a folded ledger.

    Identical lines of one manifest are all used or all skipped.
    """
    known = state.select("hash", F.col("done").alias("_done"), "token")
    rows = manifest.join(known, "hash", "left")
    rows = rows.withColumn("skipped", F.coalesce("_done", F.lit(False))).drop("_done")
    return rows.withColumn("token", F.when(~F.col("skipped"), F.col("token")))


def stage() -> Column:
    """``upload`` where a file has to be sent, ``direct`` where there is none or it was sent before."""
    return F.when((F.col("file") != "") & F.col("token").isNull(), "upload").otherwise("direct")


def stat_files(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``found`` and ``file_size`` by a join with the listing."""
    listing = entries.select(F.col("path").alias("file"), F.col("size").alias("file_size"), F.lit(True).alias("found"))
    return manifest.join(listing, "file", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def field_entries(parsed: DataFrame, record: str = "line") -> DataFrame:
    """``record, pos, name, value, language`` of every field entry."""
    rows = parsed.select(F.col(record).alias("record"), F.posexplode("entries").alias("pos", "e"))
    get = lambda key, kind: F.try_variant_get("e", f"$.{key}", kind)
    return rows.select("record", "pos", get("name", "string").alias("name"), get("value", "variant").alias("value"), get("language", "string").alias("language"))


def field_usage(manifest: DataFrame) -> DataFrame:
    """One row: ``names`` (trimmed, sorted) and ``uses_language``; malformed lines and empty names don't count."""
    entries = field_entries(parse_manifest(manifest))
    name, tag = trim_white("name"), F.coalesce(trim_white("language"), F.lit(""))
    return entries.agg(
        F.array_sort(F.collect_set(F.when(name != "", name))).alias("names"), F.coalesce(F.bool_or(tag != ""), F.lit(False)).alias("uses_language")
    )


def validate_manifest(manifest: DataFrame, entries: DataFrame | None = None, fields: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """``line, hash, id, file, action, error, warn`` of each line; lines with a saved ``token`` need no file.

    With the listing ``entries`` a file must exist; with ``fields`` each entry's field must be known, and with
    ``languages`` its language.
    """
    tokens = manifest if "token" in manifest.columns else manifest.withColumn("token", F.lit(None).cast("string"))
    parsed = parse_manifest(tokens)
    rows = structure_error(parsed).withColumn("action", action())
    if entries is not None:
        rows = stat_files(rows, entries)
        missing = (F.col("file") != "") & F.col("token").isNull() & ~F.col("found")
        rows = rows.withColumn("error", F.coalesce("error", F.when(missing, F.format_string("file not found: %s", F.col("file")))))
    if fields is not None:
        known = fields.select(canonical_field_name("name").alias("key")).distinct().withColumn("_known", F.lit(True))
        asked = field_entries(parsed).withColumn("key", canonical_field_name("name")).join(known, "key", "left")
        bad = F.when(F.col("_known").isNull(), F.format_string('unknown field "%s"', trim_white("name")))
        if languages is not None:
            spoken = languages.select(canonical_field_name("culture").alias("culture")).distinct().withColumn("_spoken", F.lit(True))
            asked = asked.withColumn("culture", canonical_field_name("language")).join(spoken, "culture", "left")
            odd = (F.coalesce("culture", F.lit("")) != "") & F.col("_spoken").isNull()
            bad = F.coalesce(bad, F.when(odd, F.format_string('unknown language "%s"', F.col("language"))))
        errors = asked.withColumn("_bad", bad).filter("_bad is not null").groupBy("record").agg(F.min_by("_bad", "pos").alias("_bad"))
        rows = rows.join(errors.withColumnRenamed("record", "line"), "line", "left").withColumn("error", F.coalesce("error", "_bad"))
    warn = F.when(F.col("error").isNull() & (F.col("file") != ""), rename_warning("file"))
    return rows.withColumn("warn", warn).select("line", "hash", "id", "file", "action", "error", "warn")
