"""Quantile edges, histograms and category shares."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.config import Feature, categorical
from siltmark.functions.columns import inline_table, rounded
from siltmark.functions.ordered import approx_quantiles, exact_quantiles

# Bin edges of a probability score.
DECILE_EDGES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def quantile_bin_edges(
    long: DataFrame,
    num_bins: int = 10,
    keys: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """``keys, feature, n, bin_edges``: distinct quantiles of each feature.

    A constant feature gets ``[v - 1, v + 1]``. Exact unless ``accuracy`` asks
    for the one-pass sketch.
    """
    probs = [i / num_bins for i in range(num_bins + 1)]
    group = [*keys, "feature"]
    if accuracy:
        q = approx_quantiles(long, probs, group, accuracy)
    else:
        q = exact_quantiles(long, probs, group, range_group=["feature"], bounded=not keys)
    return q.select(*group, "n", edges_from_quantiles(F.col("quantiles")).alias("bin_edges"))


def edges_from_quantiles(quantiles: Column) -> Column:
    distinct = F.array_distinct(quantiles)
    first = F.element_at(distinct, 1)
    return F.when(F.size(distinct) < 2, F.array(first - 1.0, first + 1.0)).otherwise(distinct)


def round_edges(edges: Column, decimals: int | None) -> Column:
    return edges if decimals is None else F.transform(edges, lambda e: F.round(e, decimals))


def most_bins(edges: DataFrame) -> int:
    """The largest number of bins in a stored edge table, which has one row per catalogued feature."""
    return edges.agg(F.coalesce(F.max(F.size("bin_edges")), F.lit(2))).first()[0] - 1


def histogram_arrays(
    long: DataFrame,
    edges: DataFrame,
    max_bins: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``keys, feature, bin_edges, counts ARRAY<BIGINT>, n``: one row per group.

    ``edges(feature, bin_edges)`` holds one row per catalogued feature, hence the
    broadcast. Outer edges act as -inf/+inf, bins are closed below. Counting
    ``value >= edge`` per inner edge needs no bin lookup, no exploded grid and a
    single partial aggregation; empty bins are there by construction.
    """
    too_many = F.raise_error(F.lit(f"more than {max_bins} bins; raise max_bins"))
    checked = edges.select(
        "feature",
        F.when(F.size("bin_edges") > max_bins + 1, too_many)
        .otherwise(F.col("bin_edges")).alias("bin_edges"),
    )
    rows = long.join(F.broadcast(checked), "feature")
    # Running "at least" counts: n, >=e1, >=e2, ...; 0 past the last bin.
    steps = ["count(value)", *[f"count_if(value >= get(bin_edges, {i}))" for i in range(1, max_bins)]]
    # Only primitive buffers: carrying the edges along would force a sort aggregate.
    grouped = rows.groupBy(*keys, "feature").agg(
        F.count("value").alias("n"), F.expr(f"array({', '.join(steps)}) AS _steps")
    )
    grouped = grouped.join(F.broadcast(checked), "feature")
    return grouped.selectExpr(
        *keys, "feature", "bin_edges",
        "transform(slice(_steps, 1, size(bin_edges) - 1), (x, i) ->"
        " x - if(i + 2 < size(bin_edges), coalesce(get(_steps, i + 1), 0L), 0L)) AS counts", "n",
    )


def histogram_by_edges(
    long: DataFrame, edges: DataFrame, max_bins: int = 10, keys: Sequence[str] = ()
) -> DataFrame:
    """Row form: ``keys, feature, bin, low, high, count, n``, empty bins included."""
    arrays = histogram_arrays(long, edges, max_bins, keys)
    return arrays.select(
        *keys, "feature", "n", "bin_edges", F.posexplode("counts").alias("bin", "count")
    ).select(
        *keys, "feature", "bin",
        F.get("bin_edges", F.col("bin")).alias("low"),
        F.get("bin_edges", F.col("bin") + 1).alias("high"),
        "count", "n",
    )


def histogram_fixed_deciles(
    df: DataFrame, score: str = "prediction_score", keys: Sequence[str] = ()
) -> DataFrame:
    """Score histogram on [0, 1]: outside scores are not binned but stay in ``n``."""
    v = F.col("_score")
    rows = df.select(*keys, numeric_score(df, score).alias("_score"))
    bins = len(DECILE_EDGES) - 1
    counts = []
    for i in range(bins):
        low, high = DECILE_EDGES[i], DECILE_EDGES[i + 1]
        upper = (v <= high) if i == bins - 1 else (v < high)
        counts.append(F.count_if((v >= low) & upper))
    agg = rows.groupBy(*keys).agg(
        F.count("_score").alias("n"), F.avg("_score").alias("mean"),
        F.array(*counts).alias("_counts"),
    )
    return agg.select(
        *keys, "n", "mean", F.posexplode("_counts").alias("bin", "count")
    ).select(
        *keys, "bin",
        F.get(F.array(*[F.lit(e) for e in DECILE_EDGES]), F.col("bin")).alias("low"),
        F.get(F.array(*[F.lit(e) for e in DECILE_EDGES]), F.col("bin") + 1).alias("high"),
        "count", rounded(F.col("count") / F.greatest("n", F.lit(1)), 5).alias("share"),
        "n", "mean",
    )


def numeric_score(df: DataFrame, name: str) -> Column:
    from siltmark.functions.columns import numeric

    return numeric(df, name)


def category_counts(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, feature, value, count, known``; map-side combined.

    Missing cells are one row per feature with ``known`` 0. Consumers filter on
    ``known``: a filter on ``value`` would be pushed below the counting and cost
    each of them its own scan instead of sharing this shuffle.
    """
    return long.groupBy(*keys, "feature", "value").agg(
        F.count(F.lit(1)).alias("count"), F.count("value").alias("known")
    )


def category_frequencies(
    long: DataFrame, features: Iterable[Feature], keys: Sequence[str] = ()
) -> DataFrame:
    """Share of each category among non-null cells; listed but unseen ones get 0."""
    keys = list(keys)
    counts = category_counts(long, keys).filter("known > 0")
    totals = counts.groupBy(*keys, "feature").agg(F.sum("count").alias("n"))
    listed = [(f.name, v) for f in categorical(features) for v in f.allowed_values]
    domain = inline_table(long.sparkSession, listed, "feature string, value string")
    grid = totals.select(*keys, "feature").join(F.broadcast(domain), "feature")
    every = counts.select(*keys, "feature", "value", "count").unionByName(
        grid.select(*keys, "feature", "value", F.lit(0).cast("long").alias("count"))
    )
    merged = every.groupBy(*keys, "feature", "value").agg(F.sum("count").alias("count"))
    return merged.join(totals, [*keys, "feature"]).select(
        *keys, "feature", F.col("value").alias("category"), "count", "n",
        rounded(F.col("count") / F.col("n"), 5).alias("share"),
    )
