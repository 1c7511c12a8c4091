"""Shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set(CHECKPOINT_SETTING, base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """The rows of ``df`` from a table written to the shared folder: lineage is cut, a lost executor costs nothing.

    With ``rows_per_file`` what one task wrote can be read by several; rows keep their order.
    """
    path = workspace(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
