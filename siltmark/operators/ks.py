"""Two-sample Kolmogorov-Smirnov statistic and p-value."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.config import Feature, numerical
from siltmark.functions.columns import inline_table, null_safe_keys, rounded
from siltmark.functions.ordered import running_totals
from siltmark.functions.pvalues import ks_p_value
from siltmark.operators.longform import present, to_long_numerical


def ks_statistic(
    ref: DataFrame, cur: DataFrame, features: Iterable[Feature], keys: Sequence[str] = ()
) -> DataFrame:
    """``keys, feature, d, ref_n, cur_n``; ``d`` is unrounded, 0 if a side is empty."""
    features, keys = list(features), list(keys)
    names = [f.name for f in present(cur, numerical(features))]
    ref_long = to_long_numerical(ref, features)
    cur_long = to_long_numerical(cur, features, keys)
    return _grouped(ref_long, cur_long, keys) if keys else _single(ref_long, cur_long, names)


def _single(ref_long: DataFrame, cur_long: DataFrame, names: list[str]) -> DataFrame:
    both = ref_long.withColumn("_ref", F.lit(1)).unionByName(cur_long.withColumn("_ref", F.lit(0)))
    counts = both.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum(F.col("_ref").cast("long")).alias("r"),
        F.sum((1 - F.col("_ref")).cast("long")).alias("c"),
    )
    # One row per catalogued feature, also for features without any value.
    zero = F.lit(0).cast("long")
    catalogue = inline_table(counts.sparkSession, [(n,) for n in names], "feature string")
    found = counts.groupBy("feature").agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"))
    sizes = catalogue.join(F.broadcast(found), "feature", "left").select(
        "feature", F.coalesce("_r", zero).alias("ref_n"), F.coalesce("_c", zero).alias("cur_n")
    )
    ecdf = running_totals(
        counts, ["feature"], ["r", "c"], range_group=["feature"], bounded=True
    )
    gap = F.abs(F.col("cum_r") / F.col("ref_n") - F.col("cum_c") / F.col("cur_n"))
    usable = (F.col("ref_n") > 0) & (F.col("cur_n") > 0)
    top = (
        ecdf.join(F.broadcast(sizes), "feature")
        .filter(usable).groupBy("feature").agg(F.max(gap).alias("d"))
    )
    return sizes.join(F.broadcast(top), "feature", "left").select(
        "feature", F.coalesce("d", F.lit(0.0)).alias("d"), "ref_n", "cur_n"
    )


def _grouped(ref_long: DataFrame, cur_long: DataFrame, keys: list[str]) -> DataFrame:
    """Every key group against the one reference, which is never replicated.

    Between two current values the current ECDF is flat and the reference ECDF
    rises, so the supremum is reached at a current value or just below one. It is
    enough to look up the reference ECDF at each current value.
    """
    group = [*keys, "feature"]
    found = F.col("value").isNotNull()
    zero = F.lit(0).cast("long")
    ref_n = ref_long.groupBy("feature").agg(F.count("value").alias("ref_n"))
    cur_n = cur_long.groupBy(*group).agg(F.count("value").alias("cur_n"))
    cur_counts = cur_long.filter(found).groupBy(*group, "value").agg(
        F.count(F.lit(1)).alias("c")
    )
    ref_counts = ref_long.filter(found).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("r")
    )
    points = ref_counts.unionByName(
        cur_counts.select("feature", "value", zero.alias("r"))
    ).groupBy("feature", "value").agg(F.sum("r").alias("r"))
    ref_ecdf = running_totals(
        points, ["feature"], ["r"], range_group=["feature"], bounded=True
    )
    cur_ecdf = running_totals(
        cur_counts, group, ["c"], range_group=["feature"], bounded=True
    )
    f_cur = F.col("cum_c") / F.col("cur_n")
    f_cur_before = (F.col("cum_c") - F.col("c")) / F.col("cur_n")
    f_ref = F.col("cum_r") / F.col("ref_n")
    f_ref_before = (F.col("cum_r") - F.col("r")) / F.col("ref_n")
    top = (
        cur_ecdf.join(ref_ecdf, ["feature", "value"])
        .join(cur_n, group)
        .join(F.broadcast(ref_n), "feature")
        .filter(F.col("ref_n") > 0)
        .groupBy(*group)
        .agg(F.max(F.greatest(f_cur - f_ref, f_ref_before - f_cur_before,
                              F.lit(0.0))).alias("d"))
    )
    return (
        cur_n.join(top, group, "left")
        .join(F.broadcast(ref_n), "feature", "left")
        .select(
            *group, F.coalesce("d", F.lit(0.0)).alias("d"),
            F.coalesce("ref_n", zero).alias("ref_n"), "cur_n",
        )
    )


@null_safe_keys
def ks_two_sample(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    keys: Sequence[str] = (),
    p_value: str | None = "auto",
) -> DataFrame:
    """``keys, feature, ks_statistic, ks_p_value, ref_n, cur_n``.

    ``p_value``: ``auto``, ``exact``, ``asymptotic``, or None to leave it out.
    """
    stat = ks_statistic(ref, cur, features, keys)
    out = [*keys, "feature", rounded(F.col("d"), 5).alias("ks_statistic")]
    if p_value:
        usable = (F.col("ref_n") > 0) & (F.col("cur_n") > 0)
        p = ks_p_value(F.when(usable, F.col("d")), F.col("ref_n"), F.col("cur_n"), p_value)
        out.append(rounded(p, 6).alias("ks_p_value"))
    return stat.select(*out, "ref_n", "cur_n")
