"""Population stability index of numerical and categorical features.

``psi = sum((p - q) * ln(p / q))`` with ``p = (c + eps) / (N + k * eps)``.
The reference side is one distribution per feature; ``keys`` (segments, windows)
split the current side only, so the reference is counted once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.config import CATEGORICAL, NUMERICAL, Feature
from siltmark.functions.columns import fixed, null_safe_keys, rounded
from siltmark.operators.binning import (
    category_counts,
    histogram_arrays,
    most_bins,
    quantile_bin_edges,
)
from siltmark.operators.longform import to_long_categorical, to_long_numerical

OTHER = "__OTHER__"


def smoothed(count: Column, total: Column, bins: Column, epsilon: float) -> Column:
    return (count + F.lit(epsilon)) / (total + bins * F.lit(epsilon))


def psi_component(p: Column, q: Column) -> Column:
    return (p - q) * F.ln(p / q)


def numerical_bins(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    bins: DataFrame | None = None,
    num_bins: int = 10,
    epsilon: float = 1e-4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per key group and feature with aligned arrays of counts and components.

    ``bins(feature, bin_edges)`` are stored edges; without them the quantiles of
    the reference are used.
    """
    features, keys = list(features), list(keys)
    ref_long = to_long_numerical(ref, features)
    limit = num_bins if bins is None else most_bins(bins)
    if bins is None:
        bins = quantile_bin_edges(ref_long, num_bins)
    edges = bins.filter(F.col("bin_edges").isNotNull()).select("feature", "bin_edges")
    left = histogram_arrays(to_long_numerical(cur, features, keys), edges, limit, keys)
    right = histogram_arrays(ref_long, edges, limit)
    ref_side = F.broadcast(right.select(
        "feature", F.col("counts").alias("ref_counts"), F.col("n").alias("ref_n")
    ))  # one row per catalogued feature
    both = left.join(ref_side, "feature").select(
        *keys, "feature", "bin_edges", F.col("counts").alias("cur_counts"),
        F.col("n").alias("cur_n"), "ref_counts", "ref_n",
    )
    return components(both, epsilon)


def components(both: DataFrame, epsilon: float) -> DataFrame:
    """Add the index components of aligned ``ref_counts`` and ``cur_counts`` arrays."""
    k = F.size("cur_counts")
    parts = F.zip_with(
        "cur_counts", "ref_counts",
        lambda c, r: psi_component(
            smoothed(c, F.col("cur_n"), k, epsilon), smoothed(r, F.col("ref_n"), k, epsilon)
        ),
    )
    usable = (F.col("ref_n") > 0) & (F.col("cur_n") > 0)
    return both.withColumns({
        "components": F.when(usable, parts),
        "degenerate_bins": k < 2,
    })


def psi_total(components: Column) -> Column:
    return F.coalesce(
        F.aggregate(components, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)
    )


@null_safe_keys
def psi_numerical(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    bins: DataFrame | None = None,
    num_bins: int = 10,
    epsilon: float = 1e-4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``keys, feature, psi, ref_n, cur_n, degenerate_bins``."""
    keys = list(keys)
    both = numerical_bins(ref, cur, features, bins, num_bins, epsilon, keys)
    return both.select(
        *keys, "feature", rounded(psi_total(F.col("components")), 5).alias("psi"),
        "ref_n", "cur_n", "degenerate_bins",
    )


def categorical_bins(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    categories: DataFrame | None = None,
    epsilon: float = 1e-4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Row form: ``keys, feature, category, ref_count, cur_count, ref_n, cur_n, k``.

    ``categories(feature, categories ARRAY)`` is the stored baseline list:
    unlisted current values fall into ``__OTHER__`` and unlisted reference values
    stay in the total only. Without it the union of both sides is used.
    """
    features, keys = list(features), list(keys)
    group = [*keys, "feature"]
    ref_all = category_counts(to_long_categorical(ref, features))
    cur_all = category_counts(to_long_categorical(cur, features, keys), keys)
    ref_n = ref_all.groupBy("feature").agg(F.expr("sum(if(known > 0, count, 0L)) AS ref_n"))
    # All-null features still show: their group has a row with ``known`` 0.
    groups = cur_all.groupBy(*group).agg(F.expr("sum(if(known > 0, count, 0L)) AS cur_n"))
    ref_counts, cur_counts = ref_all.filter("known > 0"), cur_all.filter("known > 0")
    zero = F.lit(0).cast("long")

    ref_cells = ref_counts.select("feature", F.col("value").alias("category"), "count")
    cur_cells = cur_counts.select(*group, F.col("value").alias("category"), "count")
    if categories is not None:
        listed = categories.select("feature", F.explode("categories").alias("category"))
        known = listed.withColumn("_known", F.lit(True))
        ref_cells = listed.join(ref_cells, ["feature", "category"], "left").select(
            "feature", "category", F.coalesce("count", zero).alias("count")
        )
        # A category literally named __OTHER__ in the list collects the unseen.
        cur_cells = cur_cells.join(known, ["feature", "category"], "left").select(
            *group,
            F.when(F.col("_known"), F.col("category")).otherwise(OTHER).alias("category"),
            "count",
        )
    cells = groups.select(*group).join(ref_cells, "feature").select(
        *group, "category", F.col("count").alias("ref_count"), zero.alias("cur_count")
    ).unionByName(
        cur_cells.select(
            *group, "category", zero.alias("ref_count"), F.col("count").alias("cur_count")
        )
    )
    merged = cells.groupBy(*group, "category").agg(
        F.sum("ref_count").alias("ref_count"), F.sum("cur_count").alias("cur_count")
    )
    sizes = merged.groupBy(*group).agg(F.count(F.lit(1)).alias("k"))
    return (
        merged.join(sizes, group)
        .join(groups, group)
        .join(F.broadcast(ref_n), "feature", "left")
        .withColumn("ref_n", F.coalesce("ref_n", zero))
        .select(*group, "category", "ref_count", "cur_count", "ref_n", "cur_n", "k")
    )


def _with_component(cells: DataFrame, epsilon: float) -> DataFrame:
    p = smoothed(F.col("cur_count"), F.col("cur_n"), F.col("k"), epsilon)
    q = smoothed(F.col("ref_count"), F.col("ref_n"), F.col("k"), epsilon)
    usable = (F.col("ref_n") > 0) & (F.col("cur_n") > 0)
    return cells.withColumn("component", F.when(usable, psi_component(p, q)))


def category_statistics(
    ref_counts: DataFrame, cur_counts: DataFrame, categories: DataFrame | None = None, epsilon: float = 1e-4,
    keys: Sequence[str] = (), add: int = 1,
) -> DataFrame:
    """Index and chi-square per group from ``category_counts`` of both sides, one row per group.

    Columns: ``keys, feature, psi, degenerate_bins, ref_n, cur_n, chi2`` (unrounded, ``add`` in every cell, with the
    continuity correction for two categories) and ``k``. Only categories a group has are joined with the reference; those it lacks
    enter as sums: over all reference categories of the feature minus the matched ones. So nothing has
    groups times vocabulary rows, and a reference of any size gives one row of totals per feature.
    """
    group = [*keys, "feature"]
    eps, zero = F.lit(float(epsilon)), F.lit(0).cast("long")
    ref_n = ref_counts.groupBy("feature").agg(F.expr("sum(if(known > 0, count, 0L)) AS ref_n"))
    groups = cur_counts.groupBy(*group).agg(F.expr("sum(if(known > 0, count, 0L)) AS cur_n"))
    ref_cells = ref_counts.filter("known > 0").select("feature", F.col("value").alias("category"), F.col("count").alias("_r"))
    cur_cells = cur_counts.filter("known > 0").select(*group, F.col("value").alias("category"), F.col("count").alias("_c"))
    if categories is not None:
        listed = categories.select("feature", F.explode("categories").alias("category"))
        ref_cells = listed.join(ref_cells, ["feature", "category"], "left").select("feature", "category", F.coalesce("_r", zero).alias("_r"))
        named = cur_cells.join(listed.withColumn("_known", F.lit(True)), ["feature", "category"], "left")
        label = F.when(F.col("_known"), F.col("category")).otherwise(OTHER)
        cur_cells = named.groupBy(*group, label.alias("category")).agg(F.sum("_c").alias("_c"))
    r, log_r = F.col("_r"), F.ln(F.col("_r") + eps)
    sums = {"k": F.count("_r"), "r": F.sum("_r"), "ln": F.sum(log_r), "rln": F.sum((r + eps) * log_r), "inv": F.sum(1.0 / (r + 2 * add))}
    totals = ref_cells.groupBy("feature").agg(*[x.alias(f"_all_{n}") for n, x in sums.items()])
    cells = cur_cells.join(ref_cells, ["feature", "category"], "left")
    matched = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("_cells"), *[x.alias(f"_hit_{n}") for n, x in sums.items()])
    # One row per catalogued feature on the right; groups on the left.
    sized = groups.join(matched, group, "left").join(F.broadcast(totals), "feature", "left").join(F.broadcast(ref_n), "feature", "left")

    def missing(name: str, none: Column) -> Column:
        return F.coalesce(f"_all_{name}", none) - F.coalesce(f"_hit_{name}", none)

    sized = sized.select(
        *group, "cur_n", F.coalesce("ref_n", zero).alias("ref_n"), missing("k", zero).alias("_u"), missing("r", zero).alias("_ur"),
        F.coalesce("_all_r", zero).alias("_r"),
        *[missing(n, F.lit(0.0)).alias(f"_u{n}") for n in ("ln", "rln", "inv")],
        (F.coalesce("_all_k", zero) + F.coalesce("_cells", zero) - F.coalesce("_hit_k", zero)).alias("k"),
    ).withColumns({
        "_a": F.col("cur_n") + F.col("k") * eps, "_b": F.col("ref_n") + F.col("k") * eps,
        "_rn": (F.col("_r") + F.col("k") * add).cast("double"), "_cn": (F.col("cur_n") + F.col("k") * add).cast("double"),
    })
    direct = cells.join(sized.select(*group, "k", "_a", "_b", "_rn", "_cn"), group)
    c, base = F.col("_c"), F.coalesce("_r", zero)
    psi = psi_component((c + eps) / F.col("_a"), (base + eps) / F.col("_b"))
    chi2 = _chi2_cell(base + add, c + add, F.col("_rn"), F.col("_cn"), F.col("k"))
    summed = direct.groupBy(*group).agg(F.sum(psi).alias("_psi"), F.sum(chi2).alias("_chi2"))
    a, b, u = F.col("_a"), F.col("_b"), F.col("_u")
    level = F.ln(b / a) + F.ln(eps)
    rest = eps / a * (u * level - F.col("_uln")) - ((F.col("_ur") + u * eps) * level - F.col("_urln")) / b
    x, total = F.col("_ur") + 2 * add * u, F.col("_rn") + F.col("_cn")
    spread = x * F.col("_cn") / F.col("_rn") - 2 * add * u * total / F.col("_rn") + add * add * total * total * F.col("_uinv") / (F.col("_rn") * F.col("_cn"))
    lone = _chi2_cell(x - add, F.lit(float(add)), F.col("_rn"), F.col("_cn"), F.col("k"))
    rest_chi2 = F.when(F.col("k") == 2, lone).otherwise(spread)
    usable = (F.col("ref_n") > 0) & (F.col("cur_n") > 0)
    index = F.coalesce("_psi", F.lit(0.0)) + F.when(u > 0, rest).otherwise(0.0)
    chi2 = F.coalesce("_chi2", F.lit(0.0)) + F.when(u > 0, rest_chi2).otherwise(0.0)
    return sized.join(summed, group, "left").select(
        *group, rounded(F.when(usable, index).otherwise(0.0), 5).alias("psi"), (F.col("k") < 2).alias("degenerate_bins"),
        "ref_n", "cur_n", F.when(usable & (F.col("k") > 1), chi2).alias("chi2"), "k",
    )


def _chi2_cell(ref: Column, cur: Column, ref_total: Column, cur_total: Column, k: Column) -> Column:
    """What one category adds to the statistic; with two categories gaps shrink by at most one half."""
    column, total = (ref + cur).cast("double"), ref_total + cur_total
    gap = F.abs(ref - column * ref_total / total)
    gap = F.when(k == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return gap * gap * total / column * (1.0 / ref_total + 1.0 / cur_total)


def counted_sides(ref: DataFrame, cur: DataFrame, features: Iterable[Feature], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    features = list(features)
    return category_counts(to_long_categorical(ref, features)), category_counts(to_long_categorical(cur, features, keys), keys)


@null_safe_keys
def psi_categorical(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    categories: DataFrame | None = None,
    epsilon: float = 1e-4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """``keys, feature, psi, ref_n, cur_n, degenerate_bins``."""
    keys = list(keys)
    found = category_statistics(*counted_sides(ref, cur, features, keys), categories, epsilon, keys)
    return found.select(*keys, "feature", "psi", "ref_n", "cur_n", "degenerate_bins")


def component_band(component: Column) -> Column:
    # Display bands of a component.
    return F.when(component > 0.05, "high").when(component > 0.02, "medium").otherwise("low")


def numerical_breakdown(both: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Row form of :func:`numerical_bins`: one row per bin with its label."""
    k = F.size("cur_counts")
    rows = both.filter(F.col("components").isNotNull()).select(
        *keys, "feature", "bin_edges", "ref_n", "cur_n", k.alias("_k"),
        F.posexplode(F.arrays_zip("ref_counts", "cur_counts", "components")).alias("bin", "_b"),
    )
    low = F.when(F.col("bin") == 0, "-inf").otherwise(
        fixed(F.get("bin_edges", F.col("bin")), 2)
    )
    high = F.when(F.col("bin") == F.col("_k") - 1, "+inf").otherwise(
        fixed(F.get("bin_edges", F.col("bin") + 1), 2)
    )
    return rows.select(
        *keys, "feature", F.lit(NUMERICAL).alias("feature_type"), "bin",
        F.concat(F.lit("["), low, F.lit(", "), high, F.lit("]")).alias("label"),
        rounded(F.col("_b.ref_counts") / F.col("ref_n"), 5).alias("baseline_pct"),
        rounded(F.col("_b.cur_counts") / F.col("cur_n"), 5).alias("production_pct"),
        rounded(F.col("_b.components"), 5).alias("psi_component"),
    ).withColumn("band", component_band(F.col("psi_component")))


def categorical_breakdown(
    cells: DataFrame, epsilon: float = 1e-4, keys: Sequence[str] = ()
) -> DataFrame:
    """Row form by category; ``bin`` is NULL because categories carry no order."""
    scored = _with_component(cells, epsilon).filter(F.col("component").isNotNull())
    return scored.select(
        *keys, "feature", F.lit(CATEGORICAL).alias("feature_type"),
        F.lit(None).cast("int").alias("bin"), F.col("category").alias("label"),
        rounded(F.col("ref_count") / F.col("ref_n"), 5).alias("baseline_pct"),
        rounded(F.col("cur_count") / F.col("cur_n"), 5).alias("production_pct"),
        rounded(F.col("component"), 5).alias("psi_component"),
    ).withColumn("band", component_band(F.col("psi_component")))


@null_safe_keys
def psi_breakdown(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    bins: DataFrame | None = None,
    categories: DataFrame | None = None,
    num_bins: int = 10,
    epsilon: float = 1e-4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Contribution of every bin and category to the index."""
    features = list(features)
    left = numerical_breakdown(
        numerical_bins(ref, cur, features, bins, num_bins, epsilon, keys), keys
    )
    right = categorical_breakdown(
        categorical_bins(ref, cur, features, categories, epsilon, keys), epsilon, keys
    )
    return left.unionByName(right)
