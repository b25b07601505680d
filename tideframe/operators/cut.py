"""Cutting a plan's lineage where it must be worked out once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. A session of one process may do without; others can't."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found and context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tideframe-')}"
    if found and context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return (found or context.getCheckpointDir().get()).rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
