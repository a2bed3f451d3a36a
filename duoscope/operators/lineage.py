"""Where a plan ends: results that later steps read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share, of ``spark.checkpoint.dir``; only one machine may go without one."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, for tables that a query writes and reads again."""
    return f"{shared(spark).rstrip('/')}/{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, so that every reader sees the same doubles and ties."""
    shared(df.sparkSession)
    return df.checkpoint()
