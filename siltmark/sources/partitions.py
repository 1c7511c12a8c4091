"""Hour-partitioned log tables: append and window scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.sources.files import project_available

# Partition columns and their text formats.
PARTITIONS = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}


def _utc(moment: datetime | str) -> datetime:
    value = datetime.fromisoformat(moment) if isinstance(moment, str) else moment
    return value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value.astimezone(timezone.utc)


def partition_columns(at: Column) -> dict[str, Column]:
    """Folder names of an instant, in UTC whatever the session's zone."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return {name: F.date_format(utc, fmt) for name, fmt in PARTITIONS.items()}


def write_partitioned(
    df: DataFrame,
    path: str,
    batch_time: datetime | str | None = None,
    time_col: str | None = None,
) -> str:
    """Append to ``year/month/day/hour`` folders; returns ``path``.

    The partition is the write time (or ``batch_time``); ``time_col`` partitions
    by a column instead, and then a rebalance keeps one hour in few files while a
    hot hour is split. Rows whose time cannot be read go to the default partition, which no
    window scan opens; ``unparsable_timestamps`` counts them.
    """
    if time_col:
        out = df.withColumns(partition_columns(event_time(df, time_col)))
        out = out.hint("rebalance", *[F.col(c) for c in PARTITIONS])
    else:
        t = _utc(batch_time) if batch_time else datetime.now(timezone.utc)
        out = df.withColumns({
            "year": F.lit(f"{t:%Y}"), "month": F.lit(f"{t:%m}"),
            "day": F.lit(f"{t:%d}"), "hour": F.lit(f"{t:%H}"),
        })
    out.write.mode("append").partitionBy(*PARTITIONS).parquet(path)
    return path


def hour_range(start: datetime, end: datetime) -> Column:
    """Predicate on partition columns only, so Spark prunes folders before reading."""
    code = F.lit(0)
    for name in PARTITIONS:
        code = code * 100 + F.col(name).cast("int")
    low = int(f"{start:%Y}") * 10**6 + int(f"{start:%m%d%H}")
    high = int(f"{end:%Y}") * 10**6 + int(f"{end:%m%d%H}")
    return code.between(low, high)


def hour_folders(spark: SparkSession, path: str, start: datetime, end: datetime) -> list[str]:
    """The existing hour folders of the window; only folders inside it are listed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    day = start.replace(hour=0, minute=0, second=0, microsecond=0)
    while day <= end:
        folder = f"{path}/year={day:%Y}/month={day:%m}/day={day:%d}"
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder)):
            hours = range(start.hour if day.date() == start.date() else 0, end.hour + 1 if day.date() == end.date() else 24)
            for h in hours:
                hour = f"{folder}/hour={h:02d}"
                if files.exists(spark._jvm.org.apache.hadoop.fs.Path(hour)):
                    found.append(hour)
        day += timedelta(days=1)
    return found


def _open(spark: SparkSession, path: str, folders: list[str], fmt: str) -> DataFrame | None:
    """Rows of the given hour folders; schemas and footers of these alone are read."""
    pattern = {"parquet": "*.parquet", "jsonl": "*.jsonl"}[fmt]
    reader = spark.read.options(pathGlobFilter=pattern, mergeSchema=True, basePath=path)
    try:
        return reader.parquet(*folders) if fmt == "parquet" else reader.json(folders)
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def scan_window(
    spark: SparkSession,
    path: str,
    start: datetime | str,
    end: datetime | str,
    columns: Sequence[str] | None = None,
    inclusive_end: bool = True,
    time_col: str = "timestamp",
    formats: Sequence[str] = ("parquet", "jsonl"),
) -> DataFrame:
    """Log rows of ``[start, end]``: only the window's hour folders are opened, then events filtered.

    Text timestamps are parsed as UTC; a row whose timestamp cannot be parsed is
    dropped. Without a timestamp column all rows of the hours are kept.
    """
    first, last = _utc(start), _utc(end)
    parts = []
    folders = hour_folders(spark, path, first, last)
    for fmt in formats if folders else ():
        df = _open(spark, path, folders, fmt)
        if df is None or not set(PARTITIONS) <= set(df.columns):
            continue
        df = df.filter(hour_range(first, last)).drop(*PARTITIONS)
        if time_col in df.columns:
            ts = event_time(df, time_col)
            low, high = _literal(first), _literal(last)
            df = df.filter((ts >= low) & ((ts <= high) if inclusive_end else (ts < high)))
        parts.append(df)
    if not parts:
        names = list(columns) if columns else [time_col]
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return project_available(out, columns)


def event_time(df: DataFrame, time_col: str) -> Column:
    """The time column as a timestamp, NULL where its text cannot be read; text without an offset is UTC."""
    c = F.col(time_col)
    kind = dict(df.dtypes)[time_col]
    if kind == "string":
        text = F.trim(c)
        zoned = (
            F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.concat(text, F.lit(" 00:00:00+00:00")))
            .when(text.rlike(r"\d:\d\d(:\d\d(\.\d+)?)?$") & ~text.rlike(r"[+-]\d\d:\d\d$"), F.concat(text, F.lit("+00:00")))
            .otherwise(text)
        )
        return F.try_to_timestamp(zoned)
    return c if kind == "timestamp" else c.cast("timestamp")


def _literal(moment: datetime) -> Column:
    return F.lit(f"{moment:%Y-%m-%d %H:%M:%S.%f}+00:00").cast("timestamp")


def unparsable_timestamps(df: DataFrame, time_col: str = "timestamp") -> DataFrame:
    """How many rows a window scan drops for their timestamp text."""
    bad = F.col(time_col).isNotNull() & event_time(df, time_col).isNull()
    return df.agg(F.count_if(bad).alias("unparsable"), F.count(F.lit(1)).alias("total"))
