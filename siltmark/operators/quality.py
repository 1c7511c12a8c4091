"""Data-quality checks: nulls, unknown categories, types, ranges, schema, emptiness.

All counts of all features come from one aggregation over the wide table; the
rules are applied to the few counted numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.config import Feature, Rules
from siltmark.functions.columns import fixed, numeric, rounded, unwrapped, wrapped

VIOLATION_SCHEMA = (
    "feature string, check string, severity string, metric_value double, message string"
)
_COUNTS = ("null_count", "oov_count", "bad_count", "number_count", "range_count")


def quality_counts(
    df: DataFrame, features: Iterable[Feature], keys: Sequence[str] = ()
) -> DataFrame:
    """``keys, feature, position, total_rows`` and the raw counts of each check."""
    cells = []
    for i, f in enumerate(features):
        if f.name not in df.columns:
            continue
        raw = F.col(f"`{f.name}`")
        gone = raw.isNull()
        none = F.lit(None).cast("long")
        counts = dict.fromkeys(_COUNTS, none)
        if dict(df.dtypes)[f.name] in ("double", "float"):
            gone = gone | F.isnan(raw)
        counts["null_count"] = F.count_if(gone)
        if f.is_numerical:
            v = numeric(df, f.name)
            low = (v < f.min) if f.min is not None else F.lit(False)
            high = (v > f.max) if f.max is not None else F.lit(False)
            counts["bad_count"] = F.count_if(~gone & v.isNull())
            counts["number_count"] = F.count(v)
            counts["range_count"] = F.count_if(low) + F.count_if(high)
        elif f.allowed_values:
            listed = raw.cast("string").isin(*f.allowed_values)
            counts["oov_count"] = F.count_if(~gone & ~listed)
        cells.append(F.struct(
            F.lit(f.name).alias("feature"), F.lit(i).alias("position"),
            F.lit(f.type).alias("feature_type"),
            F.lit(_bounds(f)).alias("bounds"),
            *[counts[c].alias(c) for c in _COUNTS],
        ))
    total = F.count(F.lit(1)).alias("total_rows")
    if not cells:
        return df.groupBy(*keys).agg(total).limit(0)
    wide = df.groupBy(*keys).agg(total, F.array(*cells).alias("_cells"))
    return wide.select(*keys, "total_rows", F.inline("_cells"))


def _bounds(f: Feature) -> str:
    if f.is_numerical:
        return f"[{f.min}, {f.max}]"
    return "[" + ", ".join(sorted(f.allowed_values)) + "]"


def feature_quality(
    counts: DataFrame, rules: Rules = Rules(), keys: Sequence[str] = (), compat: bool = False
) -> DataFrame:
    """Rates per feature, rounded as reported, and whether the feature passed.

    ``compat`` subtracts the null count from the non-numeric count once more, as
    the original checker did.
    """
    total = F.greatest("total_rows", F.lit(1))
    filled = F.greatest(F.col("total_rows") - F.col("null_count"), F.lit(1))
    bad = F.col("bad_count")
    if compat:
        bad = F.greatest(bad - F.col("null_count"), F.lit(0))
    rates = counts.select(
        *keys, "feature", "position", "feature_type", "bounds", "total_rows", "null_count",
        rounded(F.col("null_count") / total, 4).alias("null_pct"),
        "oov_count", rounded(F.col("oov_count") / filled, 4).alias("oov_pct"),
        bad.alias("non_numeric_count"),
        F.when(F.col("number_count") > 0,
               rounded(F.col("range_count") / F.col("number_count"), 4)).alias("out_of_bounds_pct"),
    )
    passed = (
        (F.col("null_pct") <= rules.max_null_pct)
        & F.coalesce(F.col("oov_pct") <= rules.max_oov_pct, F.lit(True))
        & F.coalesce(F.col("non_numeric_count") == 0, F.lit(True))
    )
    return rates.filter("total_rows > 0").withColumn("passed", passed)


def percent(value: Column) -> Column:
    return F.concat(fixed(value * 100, 1), F.lit("%"))


def violations(
    quality: DataFrame, rules: Rules = Rules(), keys: Sequence[str] = ()
) -> DataFrame:
    """``keys, feature, check, severity, metric_value, message``: one row per breach."""
    name = F.col("feature")
    null, oov = F.col("null_pct"), F.col("oov_pct")
    bad, out = F.col("non_numeric_count"), F.col("out_of_bounds_pct")

    def row(check: str, severity: Column, value: Column, message: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), severity.alias("severity"),
            value.cast("double").alias("metric_value"), message.alias("message"),
        )

    warning, critical = F.lit("WARNING"), F.lit("CRITICAL")
    # The sentences of the messages are part of the report format.
    rows = F.array(
        F.when(null > rules.max_null_pct, row(
            "null_rate_exceeded",
            F.when(null < rules.critical_null_pct, warning).otherwise(critical), null,
            F.concat(F.lit("Feature '"), name, F.lit("' null rate "), percent(null),
                     F.lit(f" exceeds threshold {rules.max_null_pct:.1%}")))),
        F.when(oov > rules.max_oov_pct, row(
            "oov_categories", warning, oov,
            F.concat(F.lit("Feature '"), name, F.lit("' has "), percent(oov),
                     F.lit(" out-of-vocabulary values (allowed: "), F.col("bounds"), F.lit(")")))),
        F.when(bad > 0, row(
            "type_mismatch", critical, F.lit(None),
            F.concat(F.lit("Feature '"), name, F.lit("' contains "), bad.cast("string"),
                     F.lit(" non-numeric values")))),
        F.when(out > rules.max_out_of_range_pct, row(
            "out_of_range", warning, out,
            F.concat(F.lit("Feature '"), name, F.lit("' has "), percent(out),
                     F.lit(" values outside expected range "), F.col("bounds")))),
    )
    return quality.select(
        *keys, "feature", F.explode(F.array_compact(rows)).alias("_v")
    ).select(*keys, "feature", "_v.*")


def missing_columns(df: DataFrame, features: Iterable[Feature]) -> DataFrame:
    """CRITICAL row per declared feature that the table does not have."""
    # Report sentences, here and in the next function.
    rows = [
        (f.name, "missing_column", "CRITICAL", None,
         f"Expected column '{f.name}' is missing from inference logs")
        for f in features if f.name not in df.columns
    ]
    return df.sparkSession.createDataFrame(rows, VIOLATION_SCHEMA)


def empty_dataset(df: DataFrame) -> DataFrame:
    """One CRITICAL row if the table has no rows, else none."""
    count = df.agg(F.count(F.lit(1)).alias("_n"))
    return count.filter(F.col("_n") == 0).select(
        F.lit("dataset").alias("feature"), F.lit("empty_dataset").alias("check"),
        F.lit("CRITICAL").alias("severity"), F.lit(None).cast("double").alias("metric_value"),
        F.lit("Batch has 0 records").alias("message"),
    )


def quality_report(
    df: DataFrame,
    features: Iterable[Feature],
    rules: Rules = Rules(),
    keys: Sequence[str] = (),
    compat: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(violations, feature_quality, summary)``; ``keys`` make one report per group.

    ``summary``: ``keys, passed, total_rows, violations_count, critical_count,
    warning_count``. A group passes when nothing critical was found.
    """
    features, keys = list(features), list(keys)
    quality = feature_quality(quality_counts(df, features, keys), rules, keys, compat)
    found = violations(quality, rules, keys)
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"))
    absent = missing_columns(df, features)
    if keys:  # every group lacks the same columns: catalogue-sized
        absent = groups.select(*keys).join(F.broadcast(absent))
    else:
        absent = absent.join(F.broadcast(groups.filter("total_rows > 0").select(F.lit(1))))
        found = found.unionByName(empty_dataset(df))
    found = found.unionByName(absent.select(*keys, *found.columns[len(keys):]))
    tally = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(F.col("severity") == "CRITICAL").alias("_crit"),
        F.count_if(F.col("severity") == "WARNING").alias("_warn"),
    )
    joined = (
        unwrapped(wrapped(groups, keys).join(wrapped(tally, keys), keys, "left"), keys)
        if keys else groups.crossJoin(F.broadcast(tally))
    )
    zero = F.lit(0).cast("long")
    summary = joined.select(
        *keys, (F.coalesce("_crit", zero) == 0).alias("passed"), "total_rows",
        F.coalesce("_all", zero).alias("violations_count"),
        F.coalesce("_crit", zero).alias("critical_count"),
        F.coalesce("_warn", zero).alias("warning_count"),
    )
    return found, quality, summary
