"""Long form: one row per monitored cell, so every statistic is one grouped aggregation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.config import Feature, categorical, numerical
from siltmark.functions.columns import numeric
from siltmark.sources.partitions import event_time


def present(df: DataFrame, features: Iterable[Feature]) -> list[Feature]:
    have = set(df.columns)
    return [f for f in features if f.name in have]


def to_long_numerical(
    df: DataFrame, features: Iterable[Feature], keys: Sequence[str] = ()
) -> DataFrame:
    """``keys, feature, value DOUBLE``; missing or unparsable cells are NULL rows."""
    names = [f.name for f in present(df, numerical(features))]
    return _unpivot(df, [(n, numeric(df, n)) for n in names], keys, "double")


def to_long_categorical(
    df: DataFrame, features: Iterable[Feature], keys: Sequence[str] = ()
) -> DataFrame:
    """``keys, feature, value STRING``."""
    names = [f.name for f in present(df, categorical(features))]
    return _unpivot(df, [(n, F.col(f"`{n}`").cast("string")) for n in names], keys, "string")


def _unpivot(
    df: DataFrame, cells: list[tuple[str, Column]], keys: Sequence[str], kind: str
) -> DataFrame:
    if not cells:
        empty = df.limit(0).select(
            *keys, F.lit("").alias("feature"), F.lit(None).cast(kind).alias("value")
        )
        return empty
    wide = df.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *[c.alias(n) for n, c in cells]
    )
    long = wide.unpivot(
        [f"_key_{k}" for k in keys], [n for n, _ in cells], "feature", "value"
    )
    return long.select(*[F.col(f"_key_{k}").alias(k) for k in keys], "feature", "value")


def with_window(
    df: DataFrame, time_column: str = "timestamp", size: str = "6 hours", slide: str | None = None
) -> DataFrame:
    """Add ``window_start``; half-open windows that tile the time line. Rows whose time cannot be read
    are in no window; ``unparsable_timestamps`` counts them."""
    timed = df.withColumn("_at", event_time(df, time_column))
    w = F.window("_at", size, slide) if slide else F.window("_at", size)
    return timed.withColumn("_w", w).drop("_at").withColumn("window_start", F.col("_w.start")).drop("_w")
