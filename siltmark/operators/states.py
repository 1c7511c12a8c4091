"""Baselines from states: what every hour of a log contributes, stored once and merged per window.

A state is a row per hour and feature. Counts, means, deviations and extremes merge exactly; quantiles are a KLL sketch and
distinct values an HLL sketch, so a state has a bounded size however many rows its hour has. Category counts are rows
of their own. A baseline over any number of hours reads states and never the log.

Every batch of rows adds states of its own, so late rows only add to an hour. A batch is listed in the manifest under its id:
writing it again replaces what it gave before.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.config import Feature
from siltmark.functions.columns import rounded
from siltmark.operators.binning import edges_from_quantiles
from siltmark.operators.longform import to_long_categorical, to_long_numerical
from siltmark.sources.manifest import Manifest
from siltmark.sources.partitions import event_time

#: Size of a KLL sketch and its rank error in 99 of 100 sketches, by the published law 2.296 / k**0.9021.
SKETCH = 800
HLL_BITS = 12
STATE = (
    "hour timestamp, feature string, n long, missing long, mean double, m2 double, min double, max double,"
    " quantiles binary, distinct_values binary"
)
COUNTS = "hour timestamp, feature string, category string, count long"


def rank_error(k: int = SKETCH) -> float:
    """Share of the rows by which a quantile of a sketch may be off."""
    return 2.296 / k**0.9021


def hourly_states(df: DataFrame, features: Iterable[Feature], time_col: str = "timestamp", k: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """``(states, counts)`` of the rows; those whose time cannot be read have the hour NULL."""
    features = list(features)
    timed = df.withColumn("hour", F.date_trunc("hour", event_time(df, time_col)))
    v = F.col("value")
    numbers = to_long_numerical(timed, features, ["hour"]).groupBy("hour", "feature").agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.kll_sketch_agg_double(v, k).alias("quantiles"), F.hll_sketch_agg(v.cast("string"), HLL_BITS).alias("distinct_values"),
    )
    words = to_long_categorical(timed, features, ["hour"])
    texts = words.groupBy("hour", "feature").agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.hll_sketch_agg(v, HLL_BITS).alias("distinct_values"),
    )
    counts = words.filter(v.isNotNull()).groupBy("hour", "feature", v.alias("category")).agg(F.count("*").alias("count"))
    return numbers.unionByName(texts, allowMissingColumns=True), counts


class StateStore:
    """Hourly states below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.list = Manifest(spark, path)

    def add(self, batch: str, df: DataFrame, features: Iterable[Feature], time_col: str = "timestamp", k: int = SKETCH) -> None:
        """Add the states of a batch of rows; the same batch again replaces its states."""
        states, counts = hourly_states(df, features, time_col, k)
        folder = self.list.stage(states, "states")
        entry = {"batch": batch, "folder": folder, "counts": self.list.stage(counts, "counts")}
        hour = F.col("hour").cast("long")
        entry["first"], entry["last"] = self.list.read([folder], STATE).agg(F.min(hour), F.max(hour)).first()
        self.list.publish(lambda entries: [e for e in entries if e["batch"] != batch] + [entry])

    def read(self, start: str, end: str) -> tuple[DataFrame, DataFrame]:
        """``(states, counts)`` of the hours from ``start`` until before ``end``; batches that have none are not opened."""
        _, entries = self.list.latest()
        since, until = (F.lit(t).cast("timestamp") for t in (start, end))
        a, b = self.list.spark.range(1).select(since.cast("long"), until.cast("long")).first()
        hit = [e for e in entries if e["first"] is not None and e["first"] < b and e["last"] >= a]
        hour = (F.col("hour") >= since) & (F.col("hour") < until)
        states = self.list.read([e["folder"] for e in hit], STATE)
        return states.filter(hour), self.list.read([e["counts"] for e in hit], COUNTS).filter(hour)

    def numerical_baseline(self, start: str, end: str, num_bins: int = 10) -> DataFrame:
        """``feature, n, missing, mean, std, min, max, distinct_estimate, quantiles, bin_edges`` over the hours."""
        states = self.read(start, end)[0].filter("quantiles IS NOT NULL")
        whole = states.groupBy("feature").agg(
            F.sum("n").alias("n"), F.sum("missing").alias("missing"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"),
            F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("quantiles").alias("sketch"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct_values")).alias("distinct_estimate"),
        )
        # Deviations add up around the common mean, as exactly as in one pass over the rows.
        spread = states.join(whole.select("feature", F.col("mean").alias("_m")), "feature").groupBy("feature").agg(
            F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_m"), 2)).alias("m2")
        )
        ranks = F.array(*[F.lit(i / num_bins) for i in range(num_bins + 1)])
        out = whole.join(spread, "feature").withColumn("quantiles", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", ranks)))
        return out.select(
            "feature", "n", "missing", "mean", F.sqrt(F.col("m2") / F.nullif("n", F.lit(0))).alias("std"), "min", "max",
            "distinct_estimate", "quantiles", edges_from_quantiles(F.col("quantiles")).alias("bin_edges"),
        )

    def category_shares(self, start: str, end: str) -> DataFrame:
        """``feature, category, count, share`` over the hours, a row per category; exact."""
        counts = self.read(start, end)[1].groupBy("feature", "category").agg(F.sum("count").alias("count"))
        totals = counts.groupBy("feature").agg(F.sum("count").alias("_n"))
        return counts.join(totals, "feature").select("feature", "category", "count", rounded(F.col("count") / F.col("_n"), 5).alias("share"))


def measured_rank_error(df: DataFrame, features: Iterable[Feature], baseline: DataFrame, num_bins: int = 10) -> DataFrame:
    """``feature, rank_error``: how far the baseline's quantiles are off in the rows themselves, as a share of them.

    The check beside the exact path: one scan and one aggregation, whatever the number of rows.
    """
    rows = to_long_numerical(df, list(features)).join(F.broadcast(baseline.select("feature", "quantiles")), "feature")
    v = F.col("value")
    counted = rows.groupBy("feature").agg(
        F.count(v).alias("n"),
        F.array(*[F.struct(
            F.count_if(v < F.col("quantiles")[i]).alias("below"), F.count_if(v <= F.col("quantiles")[i]).alias("upto"),
        ) for i in range(num_bins + 1)]).alias("at"),
    )
    off = F.transform("at", lambda a, i: F.greatest(
        a["below"] - F.col("n") * i / num_bins, F.col("n") * i / num_bins - a["upto"], F.lit(0.0)
    ))
    return counted.select("feature", (F.array_max(off) / F.nullif("n", F.lit(0))).alias("rank_error"))
