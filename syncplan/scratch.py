"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session has no such setting and runs on one machine (as in tests) a local folder takes its place; on a
    cluster that is an error, as executors don't see one another's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isEmpty():
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            base = have.get()
    return f"{base.rstrip('/')}/syncplan-{uuid.uuid4().hex}"
