"""Zone map of a log table: least and greatest event time of every file, so that rows stored late are found.

An hour folder says when rows were written; a row that arrives hours after its event lies in a later folder. The zone
map knows the event times of each file, so a window scan opens exactly the files that overlap the window, wherever they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.sources.files import project_available
from siltmark.sources.manifest import Manifest
from siltmark.sources.partitions import PARTITIONS, _literal, _utc, event_time

ZONES = "_zones"
SCHEMA = "file string, least timestamp, greatest timestamp, n long"


def zone_map(spark: SparkSession, path: str) -> DataFrame:
    """``file, least, greatest, n`` of the files mapped so far; a file without readable times has NULL times."""
    manifest = Manifest(spark, f"{path}/{ZONES}")
    return manifest.read([e["folder"] for e in manifest.latest()[1]], SCHEMA)


def update_zone_map(spark: SparkSession, path: str, time_col: str = "timestamp") -> int:
    """Add the files that the map lacks; returns how many. Files are listed by name, only new ones are read, in one scan
    of the time column. A run that breaks off publishes nothing; two at once publish a file twice at worst, which a
    scan takes once."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    names = names.select(F.col("_metadata.file_path").alias("file")).filter(~F.col("file").contains(f"/{ZONES}/"))
    new = [r["file"] for r in names.join(zone_map(spark, path), "file", "left_anti").collect()]  # names of new files
    if not new:
        return 0
    rows = spark.read.option("mergeSchema", True).parquet(*new)
    at = event_time(rows, time_col) if time_col in rows.columns else F.lit(None).cast("timestamp")
    zones = rows.select(F.col("_metadata.file_path").alias("file"), at.alias("_at")).groupBy("file").agg(
        F.min("_at").alias("least"), F.max("_at").alias("greatest"), F.count(F.lit(1)).alias("n")
    )
    manifest = Manifest(spark, f"{path}/{ZONES}")
    folder = manifest.stage(zones, "zones")
    manifest.publish(lambda now: [*now, {"folder": folder}])
    return len(new)


def fold_zone_map(spark: SparkSession, path: str) -> None:
    """Rewrite the map as one folder."""
    manifest = Manifest(spark, f"{path}/{ZONES}")
    _, entries = manifest.latest()
    if len(entries) > 1:
        folder = manifest.stage(zone_map(spark, path).dropDuplicates(["file"]), "zones")
        manifest.publish(lambda now: None if any(e not in now for e in entries) else [{"folder": folder}, *[e for e in now if e not in entries]])


def scan_events(
    spark: SparkSession,
    path: str,
    start: datetime | str,
    end: datetime | str,
    columns: Sequence[str] | None = None,
    inclusive_end: bool = True,
    time_col: str = "timestamp",
) -> DataFrame:
    """Rows whose event time is in ``[start, end]``, also those stored in a later hour; only overlapping files are opened.

    Files not in the map yet are added first. Rows whose time cannot be read are in no window.
    """
    update_zone_map(spark, path, time_col)
    low, high = _literal(_utc(start)), _literal(_utc(end))
    hit = zone_map(spark, path).filter((F.col("greatest") >= low) & (F.col("least") <= high)).select("file").distinct()
    files = [r["file"] for r in hit.collect()]  # names of the files that overlap the window
    if not files:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (columns or [time_col])))
    df = spark.read.option("mergeSchema", True).parquet(*files).drop(*PARTITIONS)
    ts = event_time(df, time_col)
    return project_available(df.filter((ts >= low) & ((ts <= high) if inclusive_end else (ts < high))), columns)
