"""User functions on assets and their failures: D2, D3, D4 and U1."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .companions import FIELDS


@dataclass(frozen=True)
class Enrich:
    """``fn``: from a DataFrame of planned assets to one with ``fields`` (and ``error``), in DataFrame operations."""

    fn: Callable[[DataFrame], DataFrame]

    def run(self, plan: DataFrame) -> DataFrame:
        out = self.fn(plan)
        if "fields" not in out.columns:
            raise ValueError("an enrich function returns a column 'fields': an array of (name, value, language)")
        return out if "error" in out.columns else out.withColumn("error", F.lit(None).cast("string"))


def python_fields(df: DataFrame, fn: Callable[[dict], list[dict]]) -> DataFrame:
    """Adds ``fields`` and ``error`` by a Python function of one row, in Arrow batches.

    A raised exception is the row's error; so is a result that isn't a list of entries with a name and a value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("language", pa.string())]))
        for batch in batches:
            fields, errors = [], []
            for row in batch.to_pylist():
                try:
                    got = fn(row) or []
                    if not isinstance(got, list):
                        raise TypeError("the function must return a list of entries")
                    fields.append([{"name": e["name"], "value": typed_text(e["value"]), "language": e.get("language")} for e in got])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  user code; the row is marked and the rest goes on
                    fields.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fields, kind), pa.array(errors, pa.string())], [*batch.schema.names, "fields", "error"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, fields {FIELDS}, error string")


def typed_text(value: object) -> str | None:
    """JSON text of a value: booleans, integers (also of integral floats), other numbers, text, lists and maps."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**63:
        value = int(value)
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def typed_json(value: object) -> str:
    """JSON text of a user function's value: booleans, integers (also of integral numbers), other numbers, text, lists, maps.

    What JSON can't hold (numbers that aren't finite, objects of other kinds) is an error.
    """

    def plain(x: object) -> object:
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**63:
            return int(x)
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(value), ensure_ascii=False, allow_nan=False)


def _checked(entries: object) -> list[tuple[str, str, str | None, None]]:
    if not isinstance(entries or [], list):
        raise TypeError("the function must return a list of entries")
    out = []
    for e in entries or []:
        if not isinstance(e, dict) or not isinstance(e.get("name"), str) or "value" not in e or not e.keys() <= {"name", "value", "language"}:
            raise TypeError("an entry has a name, a value and perhaps a language")
        out.append((e["name"], typed_json(e["value"]), e.get("language"), None))
    return out


_ENTRIES = StructType([StructField(n, StringType()) for n in ("name", "value", "language", "error")])


def register_fields_function(spark: SparkSession, name: str, fn: Callable[[dict, list[dict]], list[dict]]) -> None:
    """Registers ``fn`` as a table function ``name(asset, companions)`` for SQL's LATERAL.

    ``asset`` is a struct of any fields and ``companions`` an array of structs of any fields: one asset with its companions
    in, a row (name, value as JSON, language, error) for each entry out.  A raised exception, or entries of another shape,
    give one row with the error and no entry, so a record's failure touches no other.
    """

    class Fields:
        @staticmethod
        def analyze(asset: AnalyzeArgument, companions: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(asset.dataType, StructType):
                raise ValueError(f"{name}: the asset is a struct, not {asset.dataType.simpleString()}")
            of = companions.dataType.elementType if isinstance(companions.dataType, ArrayType) else None
            if not isinstance(of, StructType):
                raise ValueError(f"{name}: companions are an array of structs, not {companions.dataType.simpleString()}")
            return AnalyzeResult(schema=_ENTRIES)

        def eval(self, asset, companions):
            try:
                found = _checked(fn(asset.asDict(recursive=True), [c.asDict(recursive=True) for c in companions or []]))
            except Exception as e:  # noqa: BLE001  user code; the row is marked and the rest goes on
                found = [(None, None, None, f"{type(e).__name__}: {e}")]
            yield from found

    spark.udtf.register(name, udtf(Fields))


def lateral_fields(rows: DataFrame, name: str, asset: str = "asset", companions: str = "companions") -> DataFrame:
    """The rows with each entry of the registered function: ``name, value`` (VARIANT), ``language, error``; see above."""
    sql = f"SELECT t.*, f.name, f.value, f.language, f.error FROM {{rows}} t, LATERAL {name}(t.`{asset}`, t.`{companions}`) f"
    return rows.sparkSession.sql(sql, rows=rows).withColumn("value", F.parse_json("value"))


def concat_fields(*parts: Column | str) -> Column:
    """Entries of companions, then of enrich functions, in order and without removing any."""
    return F.concat(*(F.coalesce(F.col(p) if isinstance(p, str) else p, F.array().cast(FIELDS)) for p in parts))


def split_failed(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(good, failed): a record with any failed row fails whole, with the first error; keys default to channel and path."""
    keys = keys or ("channel_name", "path")
    failed = rows.filter("error is not null").groupBy(*keys).agg(F.min("error").alias("error"))
    return rows.join(failed.select(*keys), list(keys), "left_anti"), failed


def run_enrichers(plan: DataFrame, enrichers: Iterable[Enrich]) -> DataFrame:
    """Runs each on the plan; entries are joined in the order of the functions, the first error counts."""
    out = plan.withColumn("fields", F.array().cast(FIELDS)).withColumn("error", F.lit(None).cast("string"))
    for e in enrichers:
        out = out.withColumnsRenamed({"fields": "_fields", "error": "_error"})
        out = e.run(out)
        out = out.withColumn("fields", concat_fields("_fields", "fields")).withColumn("error", F.coalesce("_error", "error"))
        out = out.drop("_fields", "_error")
    return out
