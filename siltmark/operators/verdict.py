"""Run-level gates and verdicts, per window or for a single run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.config import Rules
from siltmark.functions.columns import rounded, unwrapped, wrapped


def min_sample_gate(
    df: DataFrame, keys: Sequence[str] = (), rules: Rules = Rules()
) -> DataFrame:
    """``keys, sample_count, gate``: OK or INSUFFICIENT_DATA."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"))
    few = F.col("sample_count") < rules.min_samples
    return counted.withColumn("gate", F.when(few, "INSUFFICIENT_DATA").otherwise("OK"))


def run_counts(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Worst index (never below 0) and how many features drifted or warn."""
    return metrics.groupBy(*keys).agg(
        rounded(F.greatest(F.coalesce(F.max("psi"), F.lit(0.0)), F.lit(0.0)), 4).alias("max_psi"),
        F.count_if(F.col("status") == "DRIFT").alias("severe_drift_count"),
        F.count_if(F.col("status") == "WARNING").alias("warning_drift_count"),
    )


def overall_status(
    severe: Column, warning: Column, prediction: Column, passed: Column, quality_warnings: Column,
    rules: Rules = Rules(),
) -> Column:
    drifted = severe >= rules.severe_feature_count
    if rules.trigger_on_prediction_drift:
        drifted = drifted | F.coalesce(prediction == "DRIFT", F.lit(False))
    return (
        F.when(drifted | ~passed, "DRIFT_DETECTED")
        .when((severe > 0) | (warning > 0) | (quality_warnings > 0), "WARNING")
        .otherwise("STABLE")
    )


def combine_runs(
    gate: DataFrame,
    counts: DataFrame,
    quality: DataFrame,
    prediction: DataFrame | None,
    keys: Sequence[str] = (),
    rules: Rules = Rules(),
) -> DataFrame:
    """One row per run: gate, counts, quality summary and prediction into a verdict.

    Inputs have one row per run. A run below the sample gate reports no drift.
    """
    keys = list(keys)
    gate, counts, quality = (wrapped(x, keys) for x in (gate, counts, quality))
    prediction = prediction if prediction is None else wrapped(prediction, keys)

    def attach(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, keys, "left") if keys else left.crossJoin(F.broadcast(right))

    runs = attach(attach(gate, counts), quality.drop("total_rows"))
    if prediction is not None:
        scored = prediction.select(
            *keys, F.col("psi").alias("prediction_psi"), F.col("status").alias("prediction_status")
        )
        runs = attach(runs, scored)
    else:
        runs = runs.withColumns({
            "prediction_psi": F.lit(None).cast("double"),
            "prediction_status": F.lit(None).cast("string"),
        })
    enough = F.col("gate") == "OK"
    zero = F.lit(0).cast("long")
    severe = F.coalesce("severe_drift_count", zero)
    warn = F.coalesce("warning_drift_count", zero)
    status = overall_status(
        severe, warn, F.col("prediction_status"), F.col("passed"),
        F.coalesce("warning_count", zero), rules,
    )
    # The sentence of a skipped run.
    note = F.concat(
        F.lit("Batch contained "), F.col("sample_count").cast("string"),
        F.lit(f" samples (minimum required: {rules.min_samples}). Drift computation skipped."),
    )
    return unwrapped(runs, keys).select(
        *keys, "sample_count",
        F.when(enough, status).otherwise(F.col("gate")).alias("overall_status"),
        F.when(enough, F.coalesce("max_psi", F.lit(0.0))).otherwise(F.lit(0.0)).alias("max_psi"),
        F.when(enough, severe).otherwise(zero).alias("severe_drift_count"),
        F.when(enough, warn).otherwise(zero).alias("warning_drift_count"),
        F.col("passed").alias("quality_passed"),
        F.coalesce("violations_count", zero).alias("violations_count"),
        F.when(enough, F.col("prediction_psi")).alias("prediction_psi"),
        F.when(enough, F.col("prediction_status")).alias("prediction_status"),
        F.when(~enough, note).alias("summary"),
    )
