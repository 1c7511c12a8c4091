"""Alert candidates, deduplication keys, suppression and cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltmark.config import Rules
from siltmark.functions.columns import fixed
from siltmark.operators.cooldown import cooldown_replay  # noqa: F401

ALERT_COLUMNS = (
    "run_id", "feature_name", "alert_type", "severity", "message", "dedup_key",
    "cooldown_hours", "candidate_at",
)


def dedup_key(feature: Column, status: Column, at: Column) -> Column:
    """First 32 hex digits of the hash of ``feature:STATUS:date``."""
    day = F.date_format(at, "yyyy-MM-dd")
    return F.substring(F.sha2(F.concat_ws(":", feature, status, day), 256), 1, 32)


def quality_dedup_key(feature: Column, check: Column) -> Column:
    """The quality key carries no date: it stays the same across days."""
    text = F.concat_ws(":", feature, F.lit("QUALITY"), check)
    return F.substring(F.sha2(text, 256), 1, 32)


def alert_candidates(
    metrics: DataFrame,
    prediction: DataFrame | None,
    violations: DataFrame,
    run_id: str = "run_id",
    at: str = "created_at",
    rules: Rules = Rules(),
) -> DataFrame:
    """Drifted and warned features, drifted prediction, critical violations.

    The inputs carry ``run_id`` and the time of the run. ``position`` is the order
    in which one run emits its candidates.
    """
    f, psi = F.col("feature"), fixed(F.col("psi"), 4)
    severe = F.col("status") == "DRIFT"
    p = F.col("ks_p_value") if "ks_p_value" in metrics.columns else F.lit(None).cast("double")
    p_text = F.coalesce(p.cast("string"), F.lit("N/A"))
    hours = F.lit(rules.cooldown_hours)
    place = F.col("position") if "position" in metrics.columns else F.lit(0)
    # The sentences of the messages, here and below, are part of the report format.
    drifted = metrics.filter(F.col("status").isin("DRIFT", "WARNING")).select(
        F.col(run_id).alias("run_id"), f.alias("feature_name"),
        F.lit("FEATURE_DRIFT").alias("alert_type"),
        F.when(severe, "CRITICAL").otherwise("WARNING").alias("severity"),
        F.when(severe, F.concat(F.lit("Critical Drift in "), f, F.lit(" (PSI: "), psi,
                                F.lit(", KS p-val: "), p_text, F.lit(")")))
        .otherwise(F.concat(F.lit("Moderate Drift in "), f, F.lit(" (PSI: "), psi, F.lit(")")))
        .alias("message"),
        dedup_key(f, F.col("status"), F.col(at)).alias("dedup_key"),
        hours.alias("cooldown_hours"), F.col(at).alias("candidate_at"), place.alias("position"),
    )
    name = F.coalesce(f, F.lit("dataset"))
    broken = violations.filter("severity = 'CRITICAL'").select(
        F.col(run_id).alias("run_id"), name.alias("feature_name"),
        F.lit("QUALITY_VIOLATION").alias("alert_type"), F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit("Data Quality Violation: "), F.col("message")).alias("message"),
        quality_dedup_key(name, F.col("check")).alias("dedup_key"),
        F.lit(rules.quality_cooldown_hours).alias("cooldown_hours"),
        F.col(at).alias("candidate_at"), F.lit(1_000_001).alias("position"),
    )
    out = drifted
    if prediction is not None:
        score = F.lit("prediction_score")
        out = out.unionByName(prediction.filter("status = 'DRIFT'").select(
            F.col(run_id).alias("run_id"), score.alias("feature_name"),
            F.lit("PREDICTION_DRIFT").alias("alert_type"), F.lit("CRITICAL").alias("severity"),
            F.concat(F.lit("Significant Prediction Drift: output distribution shifted (PSI: "),
                     psi, F.lit(")")).alias("message"),
            dedup_key(score, F.lit("DRIFT"), F.col(at)).alias("dedup_key"),
            hours.alias("cooldown_hours"), F.col(at).alias("candidate_at"),
            F.lit(1_000_000).alias("position"),
        ))
    return out.unionByName(broken)


def suppress_and_record(
    candidates: DataFrame, alerts: DataFrame, now: str
) -> DataFrame:
    """Candidates of one run that are delivered, with their ``cooldown_until``.

    Dropped: keys that an alert still covers (``cooldown_until > now``) and later
    candidates of the same key in the batch. Append the result to the alert table.
    """
    moment = F.lit(now).cast("timestamp")
    active = (
        alerts.filter(F.col("cooldown_until") > moment).select("dedup_key").distinct()
    )
    fresh = candidates.join(active, "dedup_key", "left_anti")
    rest = [c for c in fresh.columns if c not in ("dedup_key", "position")]
    order = F.struct("position", "feature_name", "alert_type", "message")
    first = fresh.groupBy("dedup_key").agg(
        F.min_by(F.struct("position", *rest), order).alias("_c")
    )
    until = moment + F.make_interval(hours=F.col("_c.cooldown_hours"))
    return first.select(
        "dedup_key", "_c.*", until.alias("cooldown_until"), F.lit(True).alias("delivered"),
        moment.alias("created_at"),
    )


def alert_digest(
    metrics: DataFrame,
    delivered: DataFrame,
    runs: DataFrame,
    run_id: str = "run_id",
    n: int = 5,
) -> DataFrame:
    """First ``n`` affected features per run in report order, and whether to notify."""
    p = [c for c in ("ks_p_value", "chi2_p_value") if c in metrics.columns]
    value = F.coalesce(*p) if p else F.lit(None).cast("double")
    w = W.partitionBy(run_id).orderBy("position")
    listed = (
        metrics.filter(F.col("status").isin("DRIFT", "WARNING"))
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
        .select(run_id, "rank", "feature", "importance", "psi", value.alias("p_value"))
    )
    sent = delivered.groupBy(run_id).agg(F.count(F.lit(1)).alias("alerts_delivered"))
    flags = runs.select(run_id, "overall_status").join(sent, run_id, "left").select(
        run_id, F.coalesce("alerts_delivered", F.lit(0).cast("long")).alias("alerts_delivered"),
        ((F.coalesce("alerts_delivered", F.lit(0)) > 0)
         | (F.col("overall_status") == "DRIFT_DETECTED")).alias("notify"),
    )
    return flags.join(listed, run_id, "left")
