"""Retraining policy and the job table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.config import Rules
from siltmark.functions.columns import fixed, unwrapped, wrapped


def retrain_decision(
    metrics: DataFrame,
    prediction: DataFrame | None,
    keys: Sequence[str] = ("run_id",),
    rules: Rules = Rules(),
) -> DataFrame:
    """``keys, severe_count, reasons, should_trigger, mode`` per run.

    Reasons: enough severe features, drifted prediction, and the first severe
    feature of high importance at or above the strict index. The per-run lists
    are bounded by the feature catalogue.
    """
    keys = list(keys)
    severe = F.col("status") == "DRIFT"
    strict = severe & (F.col("importance") == "high") & (F.col("psi") >= rules.high_importance_psi)
    place = F.col("position")
    agg = metrics.groupBy(*keys).agg(
        F.count_if(severe).alias("severe_count"),
        F.array_sort(F.collect_list(F.when(severe, F.struct(place, "feature")))).alias("_names"),
        F.min(F.when(strict, F.struct(place, F.col("feature"), F.col("psi")))).alias("_first"),
    )
    if prediction is not None:
        drifted = prediction.filter("status = 'DRIFT'").select(
            *keys, F.col("psi").alias("_pred")
        )
        agg = unwrapped(wrapped(agg, keys).join(wrapped(drifted, keys), keys, "left"), keys)
    else:
        agg = agg.withColumn("_pred", F.lit(None).cast("double"))
    names = F.array_join(F.transform("_names", lambda s: s["feature"]), ", ")
    # The sentences of the reasons are part of the report format.
    reasons = F.array_compact(F.array(
        F.when(F.col("severe_count") >= rules.severe_feature_count, F.concat(
            F.col("severe_count").cast("string"),
            F.lit(f" features have severe drift (PSI >= {rules.psi_drift:.2f}): "), names)),
        F.when(F.col("_pred").isNotNull(), F.concat(
            F.lit("Model prediction score distribution has severe drift (PSI: "),
            fixed(F.col("_pred"), 4), F.lit(")"))),
        F.when(F.col("_first").isNotNull(), F.concat(
            F.lit("High-importance feature "), F.col("_first.feature"),
            F.lit(" drifted severely (PSI: "), fixed(F.col("_first.psi"), 4), F.lit(")"))),
    ))
    return agg.select(
        *keys, "severe_count", reasons.alias("reasons"),
        (F.size(reasons) > 0).alias("should_trigger"), F.lit(rules.retrain_mode).alias("mode"),
    )


# Who opens a job, and the job's status when its dispatch works.
JOB_ORIGINS = {
    "auto_on_severe": ("AUTO_SEVERE", "RUNNING"),
    "manual": ("MANUAL_DASHBOARD", "PENDING"),
    "threshold_approval": ("TELEGRAM_APPROVE", "RUNNING"),
}


def open_retrain_jobs(
    decisions: DataFrame, now: str, approvals: DataFrame | None = None
) -> DataFrame:
    """Job rows to append, one per run that should retrain.

    ``decisions`` carries ``run_id, should_trigger, mode, reasons, dispatched``. In
    mode ``auto_on_severe`` jobs open on their own; in the other modes only runs
    listed in ``approvals(run_id, approved_by)`` get one.
    """
    due = decisions.filter("should_trigger")
    auto = due.filter("mode = 'auto_on_severe'").withColumn(
        "approved_by", F.lit(None).cast("string")
    )
    rows = auto
    if approvals is not None:
        asked = due.filter("mode <> 'auto_on_severe'").join(
            approvals.select("run_id", "approved_by"), "run_id"
        )
        rows = auto.unionByName(asked)
    origin, status = _by_mode(0), _by_mode(1)
    moment = F.lit(now).cast("timestamp")
    none = F.lit(None).cast("string")
    return rows.select(
        "run_id", origin.alias("triggered_by"),
        F.when(F.col("dispatched"), status).otherwise("FAILED").alias("status"),
        none.alias("champion_version"), none.alias("challenger_version"),
        none.alias("metrics"), "approved_by",
        F.array_join("reasons", "; ").alias("error_message"),
        moment.alias("created_at"), moment.alias("updated_at"),
    )


def _by_mode(i: int) -> Column:
    out = F.when(F.lit(False), "")
    for mode, values in JOB_ORIGINS.items():
        out = out.when(F.col("mode") == mode, values[i])
    return out


def close_pending_job(jobs: DataFrame, result: dict, now: str) -> DataFrame:
    """The job table after a training result.

    The newest PENDING job takes the result; without one a new row is added.
    ``result``: champion_version, challenger_version, verdict, metrics (dict),
    delta_auc, approved_by, event_name. The newest job is found by one partially
    aggregated ``max_by``, so nothing is sorted.
    """
    status = "COMPLETED" if result.get("verdict", "APPROVED") == "APPROVED" else "REJECTED"
    metrics = dict(result.get("metrics") or {})
    if result.get("delta_auc") is not None:
        metrics["delta_auc"] = float(result["delta_auc"])
    import json

    moment = F.lit(now).cast("timestamp")
    new = {
        "status": F.lit(status),
        "champion_version": F.lit(result.get("champion_version", "v1")),
        "challenger_version": F.lit(result.get("challenger_version", "v2")),
        "metrics": F.lit(json.dumps(metrics)),
        "approved_by": F.lit(result.get("approved_by", "System (Closed-Loop)")),
        "updated_at": moment,
    }
    newest = jobs.agg(
        F.max_by("id", F.when(F.col("status") == "PENDING", F.struct("created_at", "id"))).alias("_p"),
        F.max("id").alias("_last"),
        F.count_if(F.col("status") == "PENDING").alias("_pending"),
    )  # one row
    marked = jobs.crossJoin(F.broadcast(newest))
    hit = (F.col("_pending") > 0) & (F.col("id") == F.col("_p"))
    updated = marked.withColumns(
        {c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}
    ).select(*jobs.columns)
    added = newest.filter(F.col("_pending") == 0).select(
        (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("id"),
        F.lit(None).cast("long").alias("run_id"),
        F.lit(result.get("event_name", "workflow_dispatch")).alias("triggered_by"),
        *[v.alias(c) for c, v in new.items()],
        F.lit(None).cast("string").alias("error_message"), moment.alias("created_at"),
    )
    return updated.unionByName(added.select(*jobs.columns))
