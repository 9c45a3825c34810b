"""The corpus pipeline: five of the operators, one after the other, over whole tables.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and returns documents in the columns of
``documents``; the last one returns the pieces of packed sequences.  Nulls, empty and repeated rows are handled as the
operators say in their modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from syncplan.llm.common import read_table, stored
from syncplan.llm.decontaminate import drop_contaminated
from syncplan.llm.jaccard_join import one_of_each
from syncplan.llm.packing import pack
from syncplan.llm.quality_rules import keep_good
from syncplan.llm.secret_scan import mask_secrets
from syncplan.llm.tokens import default_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without lines that are boilerplate on their host."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack(docs, default_path("byte_bpe_50k.json"), added_tokens=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("packing", packed),
]

#: SQL can't express tokenization; tests hold the rows against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
