"""Feature and prediction drift tables: all statistics of a run side by side."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.config import NUMERICAL, Feature, Rules, categorical, features_table, numerical
from siltmark.functions.columns import fixed, inline_table, null_safe_keys, rounded, unwrapped, wrapped
from siltmark.functions.pvalues import ks_p_value
from siltmark.operators.binning import DECILE_EDGES
from siltmark.operators.chi2 import with_chi2
from siltmark.operators.comparison import numerical_comparison
from siltmark.operators.ks import ks_two_sample
from siltmark.operators.longform import present, with_window
from siltmark.operators.profile import categorical_profile
from siltmark.operators.psi import (
    categorical_bins,
    category_statistics,
    components,
    counted_sides,
    numerical_bins,
    psi_numerical,
    psi_total,
)


def feature_status(psi: Column, warning: float = 0.10, drift: float = 0.20) -> Column:
    """DRIFT, WARNING or STABLE; p-values are reported but do not decide."""
    return F.when(psi >= drift, "DRIFT").when(psi >= warning, "WARNING").otherwise("STABLE")


@null_safe_keys
def psi_table(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    bins: DataFrame | None = None,
    rules: Rules = Rules(),
    keys: Sequence[str] = (),
) -> DataFrame:
    """``keys, feature, feature_type, importance, psi, status`` for every feature.

    ``bins`` is a stored baseline (edges and category lists). A feature absent
    from either side has psi 0.
    """
    features, keys = list(features), list(keys)
    edges, listed = _stored(bins)
    shared = present(ref, present(cur, features))
    num = psi_numerical(
        ref, cur, shared, bins=edges, num_bins=rules.num_bins,
        epsilon=rules.epsilon, keys=keys,
    )
    cat = category_statistics(*counted_sides(ref, cur, shared, keys), listed, rules.epsilon, keys)
    found = num.unionByName(cat.drop("chi2", "k")).unionByName(_absent(ref, cur, features, keys))
    return _labelled(found, features, rules, keys)


def _absent(ref: DataFrame, cur: DataFrame, features: list[Feature], keys: Sequence[str]) -> DataFrame:
    """A row of index 0 per key group for every declared feature that a side does not have."""
    names = [f.name for f in features if f not in present(ref, present(cur, features))]
    groups = cur.select(*keys).distinct() if keys else cur.limit(1).select()
    listed = F.array(*[F.lit(n) for n in names]) if names else F.lit(None).cast("array<string>")
    zero = F.lit(0).cast("long")
    return groups.select(
        *keys, F.explode(listed).alias("feature")
    ).select(
        *keys, "feature", F.lit(0.0).alias("psi"), zero.alias("ref_n"), zero.alias("cur_n"),
        F.lit(True).alias("degenerate_bins"),
    )


def _stored(bins: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    if bins is None:
        return None, None
    edges = bins.filter(F.col("feature_type") == NUMERICAL).select("feature", "bin_edges")
    if "categories" not in bins.columns:
        return edges, None
    listed = bins.filter(F.col("categories").isNotNull()).select("feature", "categories")
    return edges, listed


def _labelled(
    psi: DataFrame, features: list[Feature], rules: Rules, keys: Sequence[str]
) -> DataFrame:
    catalogue = F.broadcast(features_table(psi.sparkSession, features))
    return psi.join(catalogue, "feature").select(
        *keys, "feature", "feature_type", "importance", "position", "psi",
        feature_status(F.col("psi"), rules.psi_warning, rules.psi_drift).alias("status"),
        "degenerate_bins", "ref_n", "cur_n",
    )


@null_safe_keys
def feature_drift(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    bins: DataFrame | None = None,
    rules: Rules = Rules(),
    keys: Sequence[str] = (),
    p_values: bool = True,
    histograms: bool = False,
) -> DataFrame:
    """One row per key group and feature with every statistic of the report.

    ``keys`` name segment or window columns of ``cur``; the reference is shared
    by all groups. ``histograms`` adds the nested per-bin arrays.
    """
    features, keys = list(features), list(keys)
    group = [*keys, "feature"]
    edges, listed = _stored(bins)
    shared = present(ref, present(cur, features))
    num_feats, cat_feats = numerical(shared), categorical(shared)
    parts = [_absent(ref, cur, features, keys)]
    if num_feats:
        both = components(
            numerical_comparison(ref, cur, num_feats, edges, rules.num_bins, keys), rules.epsilon
        )
        usable = (F.col("ref_n") > 0) & (F.col("cur_n") > 0)
        p = ks_p_value(F.when(usable, F.col("d")), F.col("ref_n"), F.col("cur_n"))
        parts.append(both.select(
            *group, F.expr(
                "round(coalesce(aggregate(components, 0D, (a, x) -> a + x), 0D), 5) + 0D AS psi"
            ),
            "degenerate_bins", "ref_n", "cur_n", F.expr("round(d, 5) + 0D AS ks_statistic"),
            *([rounded(p, 6).alias("ks_p_value")] if p_values else []),
            *[F.expr(t) for t in _PROFILE],
            *([_numerical_histogram().alias("histogram")] if histograms else []),
        ))
    if cat_feats:
        sides = counted_sides(ref, cur, cat_feats, keys)
        free = with_chi2(category_statistics(*sides, None, rules.epsilon, keys), p_values).drop("chi2", "k")
        cat = free
        if listed is not None:
            cat = category_statistics(*sides, listed, rules.epsilon, keys).drop("chi2", "k")
            cat = cat.join(free.drop("psi", "degenerate_bins", "ref_n", "cur_n"), group)
        if histograms:
            cells = categorical_bins(ref, cur, cat_feats, listed, rules.epsilon, keys)
            cat = cat.join(_categorical_histogram(cells, rules.epsilon, group), group)
        parts.append(_with_categories(cat, ref, cur, cat_feats, keys))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    catalogue = F.broadcast(features_table(out.sparkSession, features))
    out = out.join(catalogue, "feature").withColumn(
        "status", feature_status(F.col("psi"), rules.psi_warning, rules.psi_drift)
    )
    if p_values:
        out = _with_flags(out, rules)
    first = [*keys, "feature", "feature_type", "importance", "position", "psi", "status"]
    return out.select(*first, *[c for c in out.columns if c not in first])


def _with_flags(out: DataFrame, rules: Rules) -> DataFrame:
    """Significance flags next to the p-values; they do not change the status."""
    flags = {}
    if "ks_p_value" in out.columns:
        flags["ks_significant"] = F.col("ks_p_value") < rules.ks_p_value
    if "chi2_p_value" in out.columns:
        flags["chi2_significant"] = F.col("chi2_p_value") < rules.chi2_p_value
    return out.withColumns(flags)


_PROFILE = [
    text for side, name in (("cur", "current"), ("ref", "baseline")) for text in (
        *[f"round({side}_{c}, 2) + 0D AS {name}_{c}" for c in ("mean", "std", "median", "min", "max")],
        f"round(({side}_rows - {side}_n) / greatest({side}_rows, 1L), 4) + 0D AS {name}_missing_pct",
    )
]


def _with_categories(table, ref, cur, feats, keys) -> DataFrame:
    now = categorical_profile(cur, feats, keys)
    base = categorical_profile(ref, present(ref, feats))
    stats = [c for c in now.columns if c not in {*keys, "feature"}]
    now = now.select(*keys, "feature", *[F.col(c).alias(f"current_{c}") for c in stats])
    base = base.select("feature", *[F.col(c).alias(f"baseline_{c}") for c in stats])
    return table.join(now, [*keys, "feature"], "left").join(
        F.broadcast(base), "feature", "left"  # one row per catalogued feature
    )


def _numerical_histogram() -> Column:
    """Nested histogram; the outer bins are open, as their labels say."""
    n_ref, n_cur = F.col("ref_n"), F.col("cur_n")
    last = F.size("cur_counts") - 1

    def label(_, i):
        low = F.when(i == 0, "-inf").otherwise(fixed(F.get("bin_edges", i), 2))
        high = F.when(i == last, "+inf").otherwise(fixed(F.get("bin_edges", i + 1), 2))
        return F.concat(F.lit("["), low, F.lit(", "), high, F.lit("]"))

    return F.struct(
        F.col("bin_edges"),
        F.transform("ref_counts", lambda c: F.round(c / n_ref, 5)).alias("baseline_pct"),
        F.transform("cur_counts", lambda c: F.round(c / n_cur, 5)).alias("production_pct"),
        F.transform("components", lambda x: F.round(x, 5)).alias("psi_components"),
        F.transform("cur_counts", label).alias("bin_labels"),
    )


def _categorical_histogram(cells: DataFrame, epsilon: float, group: list[str]) -> DataFrame:
    """Arrays by category; the report lists the whole vocabulary of a feature."""
    from siltmark.operators.psi import categorical_breakdown

    rows = categorical_breakdown(cells, epsilon, group[:-1])
    ordered = F.array_sort(F.collect_list(
        F.struct("label", "baseline_pct", "production_pct", "psi_component")
    ))
    nested = rows.groupBy(*group).agg(ordered.alias("_h"))
    return nested.select(*group, F.struct(
        F.lit(None).cast("array<double>").alias("bin_edges"),
        F.transform("_h", lambda h: h["baseline_pct"]).alias("baseline_pct"),
        F.transform("_h", lambda h: h["production_pct"]).alias("production_pct"),
        F.transform("_h", lambda h: h["psi_component"]).alias("psi_components"),
        F.transform("_h", lambda h: h["label"]).alias("bin_labels"),
    ).alias("histogram"))


def decile_edges_table(df: DataFrame, score: str) -> DataFrame:
    return inline_table(
        df.sparkSession, [(score, list(DECILE_EDGES))], "feature string, bin_edges array<double>"
    )


@null_safe_keys
def prediction_drift(
    ref: DataFrame,
    cur: DataFrame,
    score: str = "prediction_score",
    rules: Rules = Rules(),
    keys: Sequence[str] = (),
    p_values: bool = True,
    histograms: bool = False,
) -> DataFrame:
    """Drift of a probability score on ten fixed bins whose outer ends are open; ``histograms`` adds the nested bins."""
    keys = list(keys)
    feature = [Feature(score, NUMERICAL, "critical")]
    both = numerical_bins(ref, cur, feature, decile_edges_table(ref, score), 10, rules.epsilon, keys)
    psi = both.select(
        *keys, "feature", rounded(psi_total(F.col("components")), 5).alias("psi"), "ref_n", "cur_n",
        *([_numerical_histogram().alias("histogram")] if histograms else []),
    )
    ks = ks_two_sample(ref, cur, feature, keys, "auto" if p_values else None)
    from siltmark.functions.columns import numeric

    mean_cur = cur.groupBy(*keys).agg(F.avg(numeric(cur, score)).alias("_mc"))
    mean_ref = ref.agg(F.avg(numeric(ref, score)).alias("_mr"))
    table = psi.join(ks.drop("ref_n", "cur_n"), [*keys, "feature"])
    table = table.join(mean_cur, keys) if keys else table.crossJoin(F.broadcast(mean_cur))
    table = table.crossJoin(F.broadcast(mean_ref))  # one row
    status = feature_status(F.col("psi"), rules.prediction_warning, rules.prediction_drift)
    out = [
        *keys, "feature", F.lit(NUMERICAL).alias("feature_type"),
        F.lit("critical").alias("importance"), "psi", status.alias("status"), "ks_statistic",
        *(["ks_p_value"] if p_values else []),
        rounded(F.coalesce("_mr", F.lit(0.0)), 4).alias("baseline_mean"),
        rounded(F.coalesce("_mc", F.lit(0.0)), 4).alias("production_mean"), "ref_n", "cur_n",
        *(["histogram"] if histograms else []),
    ]
    return table.select(*out)


def segment_drift(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    segment: str = "source_id",
    bins: DataFrame | None = None,
    rules: Rules = Rules(),
) -> DataFrame:
    """Drift of every segment against the shared baseline, with its size and worst index."""
    table = psi_table(ref, cur, features, bins, rules, [segment])
    sizes = cur.groupBy(segment).agg(F.count(F.lit(1)).alias("sample_count"))
    worst = table.groupBy(segment).agg(F.max("psi").alias("max_psi"))
    parts = [wrapped(x, [segment]) for x in (table, sizes, worst)]
    return unwrapped(parts[0].join(parts[1], segment).join(parts[2], segment), [segment])


def window_drift_series(
    ref: DataFrame,
    cur: DataFrame,
    features: Iterable[Feature],
    time_column: str = "timestamp",
    size: str = "6 hours",
    bins: DataFrame | None = None,
    rules: Rules = Rules(),
    keys: Sequence[str] = (),
    slide: str | None = None,
) -> DataFrame:
    """Drift per time window: many monitoring runs in one job."""
    windowed = with_window(cur, time_column, size, slide)
    return psi_table(ref, windowed, features, bins, rules, [*keys, "window_start"])
