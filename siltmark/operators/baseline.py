"""Baseline artifacts: bin edges, category shares, profile, reference sample."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.config import CATEGORICAL, NUMERICAL, Feature
from siltmark.functions.columns import rounded, unwrapped, wrapped
from siltmark.functions.ordered import approx_quantiles, exact_quantiles
from siltmark.operators.binning import (
    DECILE_EDGES,
    category_frequencies,
    edges_from_quantiles,
    histogram_arrays,
    histogram_fixed_deciles,
    round_edges,
)
from siltmark.operators.longform import to_long_categorical, to_long_numerical
from siltmark.sources.workspace import workspace

# Hexadecimal digits of the md5 used as a sampling key: 52 bits, exact in a double.
_KEY_DIGITS = 13

#: Buckets of the sampling key; the one with the cut is ordered.
BUCKETS = 1 << 16

#: Groups up to which the cuts of a split are broadcast; beyond that they are joined by shuffle.
BROADCAST_GROUPS = 10_000


def sampling_key(identity: Sequence[Column], seed: int) -> Column:
    """Uniform pseudo-random DOUBLE per row identity, stable across runs and engines."""
    text = F.concat_ws("|", *[c.cast("string") for c in identity], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, _KEY_DIGITS), 16, 10).cast("double")


def _cut_cells(keyed: DataFrame, wanted: Column, keys: Sequence[str]) -> DataFrame:
    """Per group the key bucket that holds the last wanted row, and how many rows of that bucket are wanted.

    Keys are uniform, so a bucket holds one row in ``BUCKETS``: one scan, counted map-side. The written table has a row
    per group.
    """
    counts = keyed.groupBy(*keys, bucket_of_key(F.col("_key")).alias("_bucket")).agg(F.count(F.lit(1)).alias("_c"))
    group, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket")  # at most BUCKETS rows a group
    placed = counts.withColumns({"_n": F.sum("_c").over(group), "_cum": F.sum("_c").over(before)})
    target = F.least(wanted, F.col("_n")).cast("long")
    cell = placed.withColumn("_w", target).filter((F.col("_w") > F.col("_cum") - F.col("_c")) & (F.col("_w") <= F.col("_cum")))
    rows = cell.select(*keys, F.col("_bucket").alias("_last"), (F.col("_w") - F.col("_cum") + F.col("_c")).alias("_rest"))
    path = workspace(keyed.sparkSession, "cuts")
    rows.write.parquet(path)
    return keyed.sparkSession.read.schema(rows.schema).parquet(path)


def bucket_of_key(key: Column) -> Column:
    return F.floor(key / float((1 << 4 * _KEY_DIGITS) // BUCKETS)).cast("int")


def _cuts(inside: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The key of the last wanted row per group, from the rows of its bucket (``_key, _rest``)."""
    order = Window.partitionBy(*keys).orderBy("_key")
    return inside.withColumn("_r", F.row_number().over(order)).filter("_r = _rest").select(*keys, F.col("_key").alias("_cut"))


def lowest_keys(
    df: DataFrame, key: Column, wanted: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``_picked``: whether the row is among the ``wanted`` lowest keys of its group.

    ``key`` is uniform in [0, 16^13) (``sampling_key``), so the bucket that holds the cut follows from one counting
    scan and holds one row in ``BUCKETS`` of a group: only that bucket is ordered. ``wanted`` may use the group size ``_n``.
    """
    keys = list(keys)
    keyed = wrapped(df, keys).withColumn("_key", key)
    cells = _cut_cells(keyed.select(*keys, "_key"), wanted, keys)
    few = cells.count() <= BROADCAST_GROUPS  # counted: the table is not shuffled by group then
    near = F.broadcast(cells) if few else cells
    slim = keyed.select(*keys, "_key", bucket_of_key(F.col("_key")).alias("_bucket"))
    inside = slim.join(near, keys) if keys else slim.crossJoin(F.broadcast(cells))  # one row
    cuts = _cuts(inside.filter("_bucket = _last"), keys)
    if keys:
        marked = keyed.join(F.broadcast(cuts) if few else cuts, keys, "left")
    else:
        marked = keyed.join(F.broadcast(cuts), how="left", on=F.lit(True))  # one row
    picked = F.coalesce(F.col("_key") <= F.col("_cut"), F.lit(False))
    return unwrapped(marked.withColumn("_picked", picked).drop("_key", "_cut"), keys)


def reference_sample(
    df: DataFrame, identity: Sequence[str], n: int = 10_000, seed: int = 42
) -> DataFrame:
    """The whole table if it has at most ``n`` rows, else ``n`` rows by lowest hash.

    Two scans: one counts hash buckets, one takes the rows up to the bucket of the cut, some ``n`` and one row in ``BUCKETS``,
    which are written and cut exactly. Rows sharing the hash of the last kept row (same identity) are all kept.
    """
    key = sampling_key([F.col(c) for c in identity], seed)
    keyed = df.withColumn("_key", key)
    cells = _cut_cells(keyed.select("_key"), F.lit(n), ())
    near = keyed.withColumn("_bucket", bucket_of_key(F.col("_key"))).join(F.broadcast(cells), F.col("_bucket") <= F.col("_last"))
    path = workspace(df.sparkSession, "candidates")
    near.write.parquet(path)
    found = df.sparkSession.read.schema(near.schema).parquet(path)
    cuts = _cuts(found.filter("_bucket = _last").select("_key", "_rest"), ())
    return found.join(F.broadcast(cuts), F.col("_key") <= F.col("_cut")).select(*df.columns)


def numerical_baseline(
    df: DataFrame,
    features: Iterable[Feature],
    num_bins: int = 10,
    edge_decimals: int | None = 4,
    accuracy: int | None = None,
) -> DataFrame:
    """Edges, shares and profile per numerical feature; features without data are left out.

    The median is read from the same quantile pass. Shares are counted with
    the unrounded edges, the stored edges are rounded.
    """
    long = to_long_numerical(df, list(features))
    probs = [i / num_bins for i in range(num_bins + 1)] + [0.5]
    if accuracy:
        q = approx_quantiles(long, probs, ["feature"], accuracy)
    else:
        q = exact_quantiles(long, probs, ["feature"], range_group=["feature"], bounded=True)
    cuts = q.select(
        "feature", F.element_at("quantiles", -1).alias("median"),
        edges_from_quantiles(F.slice("quantiles", 1, num_bins + 1)).alias("bin_edges"),
    )
    counted = histogram_arrays(long, cuts, num_bins)
    v = F.col("value")
    moments = long.groupBy("feature").agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    joined = (
        counted.join(F.broadcast(moments), "feature")
        .join(F.broadcast(cuts.select("feature", "median")), "feature")
    )
    return joined.select(
        "feature", F.lit(NUMERICAL).alias("feature_type"),
        round_edges(F.col("bin_edges"), edge_decimals).alias("bin_edges"),
        F.transform("counts", lambda c: F.round(c / F.col("n"), 5)).alias("baseline_percentages"),
        *[rounded(F.col(c), 3).alias(c) for c in ("mean", "std", "median", "min", "max")],
        F.col("n"),
    )


def categorical_baseline(df: DataFrame, features: Iterable[Feature]) -> DataFrame:
    """Sorted category list and shares per categorical feature.

    The list is the stored artifact; it is as long as the feature's vocabulary.
    """
    features = list(features)
    shares = category_frequencies(to_long_categorical(df, features), features)
    pairs = F.array_sort(F.collect_list(F.struct("category", "share")))
    return shares.groupBy("feature").agg(
        pairs.alias("_pairs"),
        F.min_by("category", F.struct(-F.col("count"), F.col("category"))).alias("top_category"),
        F.max("n").alias("n"),
    ).select(
        "feature", F.lit(CATEGORICAL).alias("feature_type"),
        F.transform("_pairs", lambda p: p["category"]).alias("categories"),
        F.map_from_entries("_pairs").alias("category_percentages"), "top_category", "n",
    )


def prediction_baseline(df: DataFrame, score: str = "prediction_score") -> DataFrame:
    """Stored histogram of the score on closed [0, 1] deciles."""
    rows = histogram_fixed_deciles(df, score)
    shares = F.array_sort(F.collect_list(F.struct("bin", "share")))
    return rows.groupBy("n", "mean").agg(shares.alias("_s")).select(
        F.lit(score).alias("feature"), F.lit(NUMERICAL).alias("feature_type"),
        F.array(*[F.lit(e) for e in DECILE_EDGES]).alias("bin_edges"),
        F.transform("_s", lambda s: s["share"]).alias("baseline_percentages"),
        rounded(F.col("mean"), 4).alias("mean"), "n",
    )


def build_baseline(
    df: DataFrame,
    features: Iterable[Feature],
    identity: Sequence[str],
    num_bins: int = 10,
    sample_size: int = 10_000,
    edge_decimals: int | None = 4,
    accuracy: int | None = None,
    seed: int = 42,
    score: str = "prediction_score",
) -> tuple[DataFrame, DataFrame]:
    """``(bins, sample)``: one artifact row per feature, and the reference sample.

    The table is scanned several times; persist it first if it is costly to make.
    """
    features = list(features)
    bins = numerical_baseline(df, features, num_bins, edge_decimals, accuracy).unionByName(
        categorical_baseline(df, features), allowMissingColumns=True
    )
    if score in df.columns:
        bins = bins.unionByName(prediction_baseline(df, score), allowMissingColumns=True)
    return bins, reference_sample(df, identity, sample_size, seed)
