"""All numerical statistics of a drift report from one scan of each side.

Cells are counted per distinct value first (map-side combined). Index, KS
statistic, quantiles, moments and missing shares are then weighted aggregations
over those counts, so neither side is read again. Expressions are SQL text: one
aggregate list per step instead of hundreds of small column calls.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.config import Feature
from siltmark.functions.ordered import running_totals
from siltmark.operators.binning import edges_from_quantiles, most_bins
from siltmark.operators.longform import to_long_numerical


# Missing cells stay in the counts as one row per feature. Filters use this aggregate
# instead of ``value IS NOT NULL``, which would be pushed below the counting and
# give every consumer its own scan instead of the shared shuffle.
_KNOWN = "count(value) AS known"


def _moments(w: str, side: str) -> list[str]:
    has = f"known > 0 AND {w} > 0"
    n = f"sum(if(known > 0, {w}, 0L))"
    return [
        f"sum({w}) AS {side}_rows", f"{n} AS {side}_n",
        f"sum(if({has}, value * {w}, NULL)) / nullif({n}, 0) AS {side}_mean",
        f"min(if({has}, value, NULL)) AS {side}_min",
        f"max(if({has}, value, NULL)) AS {side}_max",
    ]


def _ends(w: str, side: str, probs: Sequence[float]) -> list[str]:
    """Squared deviations, and the order statistics around each probability."""
    lows, highs = [], []
    for p in probs:
        low = f"floor({p!r}D * ({side}_n - 1))"
        for ranks, rank in ((lows, low), (highs, f"least({low} + 1, {side}_n - 1)")):
            ranks.append(
                f"max(if({w} > 0 AND cum_{w} - {w} <= {rank} AND {rank} < cum_{w}, value, NULL))"
            )
    return [
        f"sum(if({w} > 0, {w} * (value - {side}_mean) * (value - {side}_mean), NULL)) AS {side}_ss",
        f"array({', '.join(lows)}) AS {side}_lo", f"array({', '.join(highs)}) AS {side}_hi",
    ]


def _finish(side: str, probs: Sequence[float]) -> list[str]:
    array = f"array({', '.join(f'{p!r}D' for p in probs)})"
    spot = f"(element_at({array}, i + 1) * ({side}_n - 1))"
    return [
        f"if({side}_n > 1, sqrt({side}_ss / nullif({side}_n - 1, 0)), NULL) AS {side}_std",
        f"transform(sequence(0, {len(probs) - 1}), i -> if({side}_lo[i] = {side}_hi[i],"
        f" {side}_lo[i], {side}_lo[i] + ({side}_hi[i] - {side}_lo[i]) * ({spot} - floor({spot}))))"
        f" AS {side}_quantiles",
    ]


_SIDE = ("rows", "n", "mean", "min", "max", "std", "quantiles")


def _aggregate(df: DataFrame, group: Sequence[str], texts: Sequence[str]) -> DataFrame:
    return df.groupBy(*group).agg(*[F.expr(t) for t in texts])


def _histogram(
    counts: DataFrame, edges: DataFrame, max_bins: int, group: Sequence[str], sides: dict[str, str]
) -> DataFrame:
    """Weighted bin counts per side; ``edges`` has one row per catalogued feature."""
    steps = {
        side: ", ".join(
            [f"sum({w})", *[f"coalesce(sum(if(value >= get(bin_edges, {i}), {w}, 0L)), 0L)"
                            for i in range(1, max_bins)]]
        ) for side, w in sides.items()
    }
    binned = _aggregate(
        counts.filter("known > 0").join(F.broadcast(edges), "feature"), group,
        [f"array({s}) AS _{side}" for side, s in steps.items()],
    ).join(F.broadcast(edges), "feature")
    return binned.selectExpr(*group, "bin_edges", *[
        f"transform(slice(_{s}, 1, size(bin_edges) - 1), (x, i) ->"
        f" x - if(i + 2 < size(bin_edges), coalesce(get(_{s}, i + 1), 0L), 0L)) AS {s}_counts"
        for s in sides
    ])


def numerical_comparison(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    edges: DataFrame | None = None,
    num_bins: int = 10,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Per key group and feature: ``bin_edges, ref_counts, cur_counts, d`` and, for
    both sides, ``rows, n, mean, min, max, std, median``. Nothing is rounded.

    ``keys`` split the current side; the reference is counted once and never
    replicated. ``edges(feature, bin_edges)`` are stored edges, else the quantiles
    of the reference.
    """
    features, keys = list(features), list(keys)
    group = [*keys, "feature"]
    bins = num_bins if edges is None else most_bins(edges)
    ref_long = to_long_numerical(ref, features)
    cur_long = to_long_numerical(cur, features, keys)
    probs = [i / num_bins for i in range(num_bins + 1)] + [0.5]
    scale = {"range_group": ["feature"], "bounded": True}
    gap = (
        "max(greatest(cum_c / cur_n - cum_r / ref_n,"
        " (cum_r - r) / ref_n - (cum_c - c) / cur_n, 0D)) AS d"
    )
    if not keys:
        both = ref_long.selectExpr("feature", "value", "1L AS r", "0L AS c").unionByName(
            cur_long.selectExpr("feature", "value", "0L AS r", "1L AS c")
        )
        counts = _aggregate(both, ["feature", "value"], ["sum(r) AS r", "sum(c) AS c", _KNOWN])
        sizes = _aggregate(counts, ["feature"], _moments("r", "ref") + _moments("c", "cur"))
        ecdf = running_totals(counts.filter("known > 0"), ["feature"], ["r", "c"], **scale)
        stats = _aggregate(
            ecdf.join(F.broadcast(sizes), "feature"), ["feature"],
            [gap, *_ends("r", "ref", probs), *_ends("c", "cur", [0.5])],
        )
        # One row per catalogued feature from here on.
        stats = sizes.join(F.broadcast(stats), "feature", "left").selectExpr(
            *sizes.columns, "d", *_finish("ref", probs), *_finish("cur", [0.5])
        )
        grid = _edges(stats, edges, num_bins)
        hist = _histogram(counts, grid, bins, ["feature"], {"ref": "r", "cur": "c"})
        out = stats.join(F.broadcast(hist), "feature", "left")
    else:
        ref_counts = _aggregate(ref_long, ["feature", "value"], ["count(1) AS r", _KNOWN])
        cur_counts = _aggregate(cur_long, [*group, "value"], ["count(1) AS c", _KNOWN])
        ref_sizes = _aggregate(ref_counts, ["feature"], _moments("r", "ref"))
        cur_sizes = _aggregate(cur_counts, group, _moments("c", "cur"))
        # The reference ECDF at every value of either side; current groups look it up.
        points = _aggregate(
            ref_counts.unionByName(cur_counts.selectExpr("feature", "value", "0L AS r", "known")),
            ["feature", "value"], ["sum(r) AS r", "sum(known) AS known"],
        ).filter("known > 0")
        ref_ecdf = running_totals(points, ["feature"], ["r"], **scale)
        cur_ecdf = running_totals(cur_counts.filter("known > 0"), group, ["c"], **scale)
        ref_stats = ref_sizes.join(F.broadcast(_aggregate(
            ref_ecdf.join(F.broadcast(ref_sizes), "feature"), ["feature"], _ends("r", "ref", probs)
        )), "feature", "left").selectExpr(*ref_sizes.columns, *_finish("ref", probs))
        looked = (
            cur_ecdf.join(ref_ecdf, ["feature", "value"])
            .join(F.broadcast(ref_sizes.select("feature", "ref_n")), "feature").join(cur_sizes, group)
        )
        cur_stats = cur_sizes.join(
            _aggregate(looked, group, [gap, *_ends("c", "cur", [0.5])]), group, "left"
        ).selectExpr(*cur_sizes.columns, "d", *_finish("cur", [0.5]))
        grid = _edges(ref_stats, edges, num_bins)
        ref_hist = _histogram(ref_counts, grid, bins, ["feature"], {"ref": "r"})
        cur_hist = _histogram(cur_counts, grid, bins, group, {"cur": "c"})
        out = (
            cur_stats.join(cur_hist.drop("bin_edges"), group, "left")
            .join(F.broadcast(ref_stats), "feature", "left")
            .join(F.broadcast(ref_hist), "feature", "left")
        )
    zero = "transform(bin_edges, x -> 0L)"
    return out.selectExpr(
        *group, "bin_edges",
        f"coalesce(ref_counts, slice({zero}, 1, size(bin_edges) - 1)) AS ref_counts",
        f"coalesce(cur_counts, slice({zero}, 1, size(bin_edges) - 1)) AS cur_counts",
        "coalesce(ref_n, 0L) AS ref_n", "coalesce(cur_n, 0L) AS cur_n",
        "if(ref_n > 0 AND cur_n > 0, d, 0D) AS d",
        *[f"coalesce({s}_rows, 0L) AS {s}_rows" for s in ("ref", "cur")],
        *[f"{s}_{c}" for s in ("ref", "cur") for c in ("mean", "std", "min", "max")],
        "element_at(ref_quantiles, -1) AS ref_median", "cur_quantiles[0] AS cur_median",
    )


def _edges(stats: DataFrame, edges: DataFrame | None, num_bins: int) -> DataFrame:
    if edges is not None:
        return edges.select("feature", "bin_edges")
    quantiles = F.slice("ref_quantiles", 1, num_bins + 1)
    return stats.filter("ref_n > 0").select(
        "feature", edges_from_quantiles(quantiles).alias("bin_edges")
    )
