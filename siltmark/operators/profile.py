"""Per-feature summary statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.config import Feature
from siltmark.functions.columns import rounded
from siltmark.functions.ordered import approx_quantiles, exact_quantiles
from siltmark.operators.binning import category_counts
from siltmark.operators.longform import to_long_categorical, to_long_numerical


def medians(
    long: DataFrame, keys: Sequence[str] = (), accuracy: int | None = None
) -> DataFrame:
    group = [*keys, "feature"]
    if accuracy:
        q = approx_quantiles(long, [0.5], group, accuracy)
    else:
        q = exact_quantiles(long, [0.5], group, range_group=["feature"], bounded=not keys)
    return q.select(*group, F.element_at("quantiles", 1).alias("median"))


def numeric_summary(
    df: DataFrame,
    features: Iterable[Feature],
    keys: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Unrounded ``rows, n, missing, mean, std, std_pop, median, min, max``."""
    group = [*keys, "feature"]
    long = to_long_numerical(df, list(features), keys)
    v = F.col("value")
    basic = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"),
        F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    return basic.join(medians(long, keys, accuracy), group, "left")


def numeric_profile(
    df: DataFrame,
    features: Iterable[Feature],
    keys: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Report profile: sample deviation, two decimals, share of missing cells."""
    s = numeric_summary(df, features, keys, accuracy)
    return s.select(
        *keys, "feature",
        *[rounded(F.col(c), 2).alias(c) for c in ("mean", "std", "median", "min", "max")],
        rounded(F.col("missing") / F.greatest("rows", F.lit(1)), 4).alias("missing_pct"),
    )


def baseline_profile(
    df: DataFrame,
    features: Iterable[Feature],
    keys: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Baseline profile: population deviation, three decimals."""
    s = numeric_summary(df, features, keys, accuracy)
    return s.filter(F.col("n") > 0).select(
        *keys, "feature", rounded(F.col("mean"), 3).alias("mean"),
        rounded(F.col("std_pop"), 3).alias("std"),
        *[rounded(F.col(c), 3).alias(c) for c in ("median", "min", "max")],
    )


def categorical_profile(
    df: DataFrame, features: Iterable[Feature], keys: Sequence[str] = ()
) -> DataFrame:
    """Mode (smallest on ties), exact distinct count, share of missing cells.

    Built on (feature, value) counts, so a feature with very many categories
    never sits in one aggregation buffer.
    """
    group = [*keys, "feature"]
    long = to_long_categorical(df, list(features), keys)
    counts = category_counts(long, keys)
    sizes = counts.groupBy(*group).agg(
        F.sum("count").alias("_rows"), F.expr("sum(if(known > 0, 0L, count)) AS _missing")
    )
    tops = counts.filter("known > 0").groupBy(*group).agg(
        F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("_top"),
        F.count(F.lit(1)).alias("_distinct"),
    )
    return sizes.join(tops, group, "left").select(
        *group, F.coalesce("_top", F.lit("N/A")).alias("top_category"),
        F.coalesce("_distinct", F.lit(0).cast("long")).alias("unique_count"),
        rounded(F.col("_missing") / F.greatest("_rows", F.lit(1)), 4).alias("missing_pct"),
    )
