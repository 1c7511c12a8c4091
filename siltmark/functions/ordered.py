"""Exact order statistics and running totals without one task per group.

A window ordered by value inside a feature would put that whole feature into
one task. Here every value is placed by a monotone function into a two-level
bucket (``d1``, ``d2``), each level having at most ``FANOUT`` children:

* running totals = offset of the ``d1`` bucket + offset of ``d2`` inside it +
  running total inside the leaf. The two offset windows hold at most ``FANOUT``
  rows each; leaf windows hold one narrow slice of distinct values;
* an order statistic needs only the leaves that contain the wanted ranks: count
  per bucket, keep the bucket that holds the rank, descend. Shuffled rows are
  bucket counts, whose number does not grow with the data.

There is one plan for every input size. Values must not be NULL: callers leave missing cells out.

The bucket function uses exact minima and maxima and no sampling, so any plan
branch that is recomputed (lost executor, exchange not reused) sees the same
buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A group has at most FANOUT ** 2 rows of bucket counts, which several steps sort and join: with many groups (windows)
# they are what a running total costs, so the buckets are no finer than a leaf window needs.
FANOUT = 256

# Into how many parts the rows of a group are spread where they meet the group's range.
PARTS = 64

# log1p(largest double) is 709.78; infinities are placed just outside.
_LOG_LIMIT = 710.0


def squash(value: Column) -> Column:
    """Monotone, finite image of a double; tames outliers and sentinels."""
    logged = F.log1p(F.abs(value))
    return F.least(F.signum(value) * F.least(logged, F.lit(_LOG_LIMIT)), F.lit(_LOG_LIMIT))


def _unit(value: Column, low: Column, high: Column) -> Column:
    span = high - low
    return F.when(span > 0, (squash(value) - low) / span).otherwise(F.lit(0.0))


def _digits(value: Column, low: Column, high: Column) -> tuple[Column, Column]:
    scaled = _unit(value, low, high) * FANOUT
    d1 = F.least(F.floor(scaled).cast("int"), F.lit(FANOUT - 1))
    d2 = F.least(F.floor((scaled - d1) * FANOUT).cast("int"), F.lit(FANOUT - 1))
    return d1, d2


def value_ranges(df: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """Exact squashed minimum and maximum per group."""
    t = squash(F.col(value))
    return df.groupBy(*group).agg(F.min(t).alias("_low"), F.max(t).alias("_high"))


def _with_ranges(
    df: DataFrame, ranges: DataFrame, group: Sequence[str], bounded: bool, value: str = "value"
) -> DataFrame:
    if not group:
        return df.crossJoin(F.broadcast(ranges))  # exactly one row
    if bounded:
        return df.join(F.broadcast(ranges), list(group))
    # Joined on the group alone, all rows of a group would meet in one task, and stay there for every later step
    # that groups by it and its buckets. Each range is repeated, and the rows of a group are spread over the copies.
    copies = ranges.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    spread = df.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(PARTS)).cast("int"))
    return spread.join(copies, [*group, "_part"]).drop("_part")


def running_totals(
    counts: DataFrame,
    keys: Sequence[str],
    sums: Sequence[str],
    value: str = "value",
    range_group: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """Add ``cum_<c>``, the inclusive running total of each ``c`` by value.

    ``counts`` has one row per ``keys`` and value. ``range_group`` is the part
    of ``keys`` that shares one value scale; ``bounded`` says that the number of
    such groups is bounded by the catalogue, so that their ranges may be broadcast.
    """
    keys, sums = list(keys), list(sums)
    ranges = value_ranges(counts, range_group, value)
    placed = _with_ranges(counts, ranges, range_group, bounded, value)
    d1, d2 = _digits(F.col(value), F.col("_low"), F.col("_high"))
    placed = placed.withColumns({"_d1": d1, "_d2": d2}).drop("_low", "_high")

    second = placed.groupBy(*keys, "_d1", "_d2").agg(*[F.sum(c).alias(c) for c in sums])
    first = second.groupBy(*keys, "_d1").agg(*[F.sum(c).alias(c) for c in sums])

    before = (W.unboundedPreceding, -1)
    w1 = W.partitionBy(*keys).orderBy("_d1").rowsBetween(*before)
    w2 = W.partitionBy(*keys, "_d1").orderBy("_d2").rowsBetween(*before)
    off1 = first.select(
        *keys, "_d1",
        *[F.coalesce(F.sum(c).over(w1), F.lit(0)).alias(f"_o1_{c}") for c in sums],
    )
    off2 = second.select(
        *keys, "_d1", "_d2",
        *[F.coalesce(F.sum(c).over(w2), F.lit(0)).alias(f"_o2_{c}") for c in sums],
    )
    offsets = off2.join(off1, [*keys, "_d1"]).select(
        *keys, "_d1", "_d2",
        *[(F.col(f"_o1_{c}") + F.col(f"_o2_{c}")).alias(f"_off_{c}") for c in sums],
    )
    leaf = (
        W.partitionBy(*keys, "_d1", "_d2").orderBy(value)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    inside = placed.withColumns({f"_in_{c}": F.sum(c).over(leaf) for c in sums})
    out = inside.join(offsets, [*keys, "_d1", "_d2"])
    return out.select(
        *counts.columns,
        *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(f"cum_{c}") for c in sums],
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    targets: DataFrame,
    value: str = "value",
    range_group: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """Add to each row of ``targets(keys..., rank, ...)`` the value at that 0-based rank.

    ``df`` holds ``keys`` and a non-null double ``value``. Exact. Three narrow
    passes: bucket counts, sub-bucket counts of the wanted buckets, values of
    the wanted leaves. The targets of a bucket travel with it as one short list,
    so the plan is a chain. ``bounded``: the number of key groups is bounded by
    the catalogue, so the lists may be broadcast; otherwise Spark picks the join.
    """
    keys = list(keys)
    small = F.broadcast if bounded else (lambda d: d)
    rows = df.select(*keys, value)
    ranges = value_ranges(rows, range_group, value)
    d1, d2 = _digits(F.col(value), F.col("_low"), F.col("_high"))
    rows = (
        _with_ranges(rows, ranges, range_group, bounded, value)
        .withColumns({"_d1": d1, "_d2": d2})
        .select(*keys, value, "_d1", "_d2")
    )
    payload = [c for c in targets.columns if c not in keys]
    found = targets.select(*keys, F.struct(*payload).alias("_t"), F.col("rank").alias("_left"))
    path: list[str] = []
    for level in ("_d1", "_d2", value):
        on = keys + path
        # A short list per bucket: at most the number of targets of one group.
        lists = found.groupBy(*on).agg(F.collect_list(F.struct("_t", "_left")).alias("_ts"))
        inside = rows.join(small(found.select(*on).distinct()), on, "left_semi") if path else rows
        # Only primitive columns here: an array buffer would force a sort aggregate.
        counted = inside.groupBy(*on, level).agg(F.count(F.lit(1)).alias("_n"))
        if on:
            counted = counted.join(small(lists), on)
        else:
            counted = counted.crossJoin(F.broadcast(lists))  # one row
        w = W.partitionBy(*on).orderBy(level).rowsBetween(W.unboundedPreceding, W.currentRow)
        spans = counted.withColumn("_end", F.sum("_n").over(w)).withColumn(
            "_start", F.col("_end") - F.col("_n")
        )
        here = F.filter(
            "_ts", lambda t: (t["_left"] >= F.col("_start")) & (t["_left"] < F.col("_end"))
        )
        found = spans.select(*on, level, "_start", F.explode(here).alias("_x")).select(
            *on, level, F.col("_x._t").alias("_t"), (F.col("_x._left") - F.col("_start")).alias("_left")
        )
        path.append(level)
    return found.select(*keys, *[F.col(f"_t.{c}").alias(c) for c in payload], value)


def exact_quantiles(
    df: DataFrame,
    probabilities: Sequence[float],
    keys: Sequence[str],
    value: str = "value",
    range_group: Sequence[str] = (),
    bounded: bool = False,
) -> DataFrame:
    """``keys, n, quantiles ARRAY<DOUBLE>`` with linear interpolation, exact."""
    keys = list(keys)
    rows = df.select(*keys, value).filter(F.col(value).isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    spots = sizes.select(*keys, "n", F.posexplode(probs).alias("_i", "_p")).withColumn(
        "_pos", F.col("_p") * (F.col("n") - 1)
    )
    low = F.floor("_pos")
    # Two order statistics per probability; the weight is that of the upper one.
    ends = F.array(
        F.struct(low.alias("rank"), F.lit(0).alias("upper")),
        F.struct(F.least(low + 1, F.col("n") - 1).alias("rank"), F.lit(1).alias("upper")),
    )
    targets = spots.select(
        *keys, "n", "_i", (F.col("_pos") - low).alias("_frac"), F.explode(ends).alias("_e")
    ).select(*keys, "_e.rank", "_e.upper", "n", "_i", "_frac")
    values = order_statistics(rows, keys, targets, value, range_group, bounded)
    pairs = values.groupBy(*keys, "n", "_i", "_frac").agg(
        F.max(F.when(F.col("upper") == 0, F.col(value))).alias("_lo"),
        F.max(F.when(F.col("upper") == 1, F.col(value))).alias("_hi"),
    )
    point = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    )
    # One entry per requested probability: the list is bounded by the request.
    listed = F.array_sort(F.collect_list(F.struct(F.col("_i"), point.alias("v"))))
    return pairs.groupBy(*keys, "n").agg(F.transform(listed, lambda s: s["v"]).alias("quantiles"))


def approx_quantiles(
    df: DataFrame,
    probabilities: Sequence[float],
    keys: Sequence[str],
    accuracy: int,
    value: str = "value",
) -> DataFrame:
    """One-pass sketch variant of :func:`exact_quantiles` for very large inputs."""
    rows = df.filter(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(value, [float(p) for p in probabilities], accuracy).alias("quantiles"),
    )
