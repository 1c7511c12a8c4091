"""Column helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.sources.workspace import workspace

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 500
GAP = r"[\x20\x09-\x0D]+"


def word_array(text: Column) -> Column:
    """Words of a text; NULL and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unit_hash(*parts: Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from md5, which every SQL engine has."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Python tasks started inside get ``rows`` rows at a time, so that long texts don't fill a worker."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder: lineage is cut and the size is known."""
    path = workspace(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return reread(df.sparkSession, path, df)


def reread(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)
