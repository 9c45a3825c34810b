"""Binary files through Spark's own writers and readers, so any store that Spark reaches will do.

The text writer takes bytes as they are and ends each row with a separator, which the formats here count as part of
themselves.  Its commit protocol keeps files of failed or repeated tasks out.  ``binaryFile`` reads them again, one
row a file, so writers keep files to a bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blocks(df: DataFrame, path: str, block: str, separator: bytes, **options) -> None:
    """Each row's bytes in column ``block`` and the separator, in the order of the rows of each partition: one file each."""
    (
        df.select(F.col(block).cast("string").alias("value"))
        .write.option("lineSep", separator.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .options(**options)
        .text(path)
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
