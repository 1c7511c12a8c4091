"""Report building, flattening, and the views over run and metric tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_report(
    runs: DataFrame, metrics: DataFrame, violations: DataFrame, run_id: str = "run_id"
) -> DataFrame:
    """One nested row per run: its features and violations as arrays of structs.

    The arrays are bounded by the feature catalogue.
    """
    cells = [c for c in metrics.columns if c != run_id]
    features = metrics.groupBy(run_id).agg(
        F.array_sort(F.collect_list(F.struct(*_position_first(cells)))).alias("features")
    )
    breaches = violations.groupBy(run_id).agg(
        F.array_sort(F.collect_list(
            F.struct("feature", "check", "severity", "metric_value", "message")
        )).alias("violations")
    )
    return runs.join(features, run_id, "left").join(breaches, run_id, "left")


def _position_first(cells: list[str]) -> list[str]:
    return sorted(cells, key=lambda c: c != "position")


def explode_report(reports: DataFrame, run_id: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """``(drift_runs, feature_metrics)``: one row per run and one per feature."""
    quality = F.to_json(F.struct(F.col("quality_passed").alias("passed"), "violations"))
    runs = reports.withColumn("quality_report", quality).drop("features", "violations")
    metrics = reports.select(run_id, F.explode("features").alias("_f")).select(run_id, "_f.*")
    return runs, metrics


def report_tables(
    runs: DataFrame, metrics: DataFrame, violations: DataFrame, prediction: DataFrame | None, hours: int = 6, run_id: str = "run_id"
) -> tuple[DataFrame, DataFrame]:
    """``(drift_runs, feature_metrics)`` as stored for dashboards: windows, counts and verdict, documents as JSON text.

    A run without prediction scores has a NULL ``prediction_drift``; statistics a feature's type lacks are NULL.
    """
    breaches = violations.groupBy(run_id).agg(
        F.array_sort(F.collect_list(F.struct("feature", "check", "severity", "metric_value", "message"))).alias("_v")
    )  # bounded by the catalogue
    table = runs.join(breaches, run_id, "left")
    quality = F.to_json(F.struct(F.col("quality_passed").alias("passed"), "violations_count", F.col("_v").alias("violations")))
    score = F.lit(None).cast("string")
    if prediction is not None:
        cells = [c for c in prediction.columns if c not in (run_id, "created_at", "window_start")]
        table = table.join(prediction.select(run_id, F.to_json(F.struct(*cells)).alias("_p")), run_id, "left")
        score = F.when(F.col("prediction_status").isNotNull(), F.col("_p"))
    drift_runs = table.select(
        run_id, "window_start", (F.col("window_start") + F.expr(f"INTERVAL {hours} HOURS")).alias("window_end"), "sample_count",
        "overall_status", "max_psi", "severe_drift_count", "warning_drift_count", quality.alias("quality_report"),
        score.alias("prediction_drift"), "summary", "created_at",
    )

    def document(prefix: str):
        cells = [c for c in metrics.columns if c.startswith(prefix)]
        return F.to_json(F.struct(*[F.col(c).alias(c[len(prefix):]) for c in cells]))

    named = [c for c in ("ks_statistic", "ks_p_value", "chi2_statistic", "chi2_p_value") if c in metrics.columns]
    feature_metrics = metrics.select(
        run_id, F.col("feature").alias("feature_name"), "feature_type", "importance", "psi", "status", *named,
        document("baseline_").alias("baseline_stats"), document("current_").alias("current_stats"),
        *([F.to_json("histogram").alias("histogram_data")] if "histogram" in metrics.columns else []), "created_at",
    )
    return drift_runs, feature_metrics


def filter_metrics(metrics: DataFrame, search: str = "", status: str = "ALL") -> DataFrame:
    """Case-insensitive substring of the name, and a status or ``ALL``."""
    out = metrics
    if search:
        out = out.filter(F.lower("feature").contains(search.lower()))
    return out if status == "ALL" else out.filter(F.col("status") == status)


def reclassify(
    metrics: DataFrame, thresholds: Iterable[tuple[float, float]], keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Status under other ``(warn, severe)`` thresholds: ``(features, overall)``.

    Each pair chosen by the user gives its own classification of all metrics.
    """
    pairs = F.array(*[
        F.struct(F.lit(float(w)).alias("warn"), F.lit(float(s)).alias("severe"))
        for w, s in thresholds
    ])
    swept = metrics.select("*", F.inline(pairs))
    status = (
        F.when(F.col("psi") >= F.col("severe"), "DRIFT")
        .when(F.col("psi") >= F.col("warn"), "WARNING").otherwise("STABLE")
    )
    features = swept.withColumn("status", status)
    overall = features.groupBy(*keys, "warn", "severe").agg(
        F.count_if(F.col("status") == "DRIFT").alias("severe_count"),
        F.count_if(F.col("status") == "WARNING").alias("warning_count"),
    ).withColumn(
        "overall_status",
        F.when(F.col("severe_count") > 0, "DRIFT_DETECTED")
        .when(F.col("warning_count") > 0, "WARNING").otherwise("STABLE"),
    )
    return features, overall


def latest_runs(runs: DataFrame, n: int = 15, at: str = "created_at") -> DataFrame:
    """Newest ``n`` runs as an ascending trend."""
    return runs.orderBy(F.col(at).desc(), F.col("run_id").desc()).limit(n).orderBy(at, "run_id")


def newest_run(runs: DataFrame, at: str = "created_at") -> DataFrame:
    """The newest run as one row, by a partial aggregate instead of a sort."""
    whole = F.struct(*runs.columns)
    return runs.agg(F.max_by(whole, F.struct(at, "run_id")).alias("_r")).select("_r.*")


def run_features(runs: DataFrame, metrics: DataFrame, at: str = "created_at") -> DataFrame:
    """Metrics of the newest run, worst first."""
    latest = newest_run(runs, at).select("run_id")
    return metrics.join(F.broadcast(latest), "run_id", "left_semi").orderBy(F.desc("psi"))


def latest_feature_detail(
    runs: DataFrame, metrics: DataFrame, at: str = "created_at"
) -> DataFrame:
    """Newest metric row per feature that belongs to a known run."""
    joined = metrics.join(
        runs.select("run_id", F.col(at).alias("run_created_at")), "run_id"
    )
    rest = [c for c in joined.columns if c != "feature"]
    return joined.groupBy("feature").agg(
        F.max_by(F.struct(*rest), F.struct("run_created_at", "run_id")).alias("_m")
    ).select("feature", "_m.*")


def sort_page(
    metrics: DataFrame, order: str = "desc", page: int = 1, size: int = 10
) -> DataFrame:
    """One page of the table by index, with ``total_pages`` (at least 1)."""
    key: Column = F.coalesce("psi", F.lit(0.0))
    columns = [key.desc() if order == "desc" else key.asc()]
    columns += [F.col(c) for c in ("run_id", "feature") if c in metrics.columns]
    total = metrics.agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("long").alias("total_pages")
    )
    chosen = metrics.orderBy(*columns).offset((page - 1) * size).limit(size)
    return chosen.crossJoin(F.broadcast(total))  # one row


def job_history(jobs: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` jobs, newest first."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def active_champion(jobs: DataFrame) -> DataFrame:
    """The newest COMPLETED job as the active model, one row or none."""
    done = jobs.filter("status = 'COMPLETED'")
    best = done.agg(F.max_by(F.struct(*jobs.columns), "id").alias("_j"))
    return best.filter("_j IS NOT NULL").select(
        F.col("_j.challenger_version").alias("version"),
        F.coalesce("_j.updated_at", "_j.created_at").alias("promoted_at"),
        F.col("_j.metrics").alias("metrics"),
    )


def kpi_summary(
    runs: DataFrame, metrics: DataFrame, severe: float = 0.20, warn: float = 0.10,
    at: str = "created_at",
) -> DataFrame:
    """Headline numbers of the newest run."""
    latest = newest_run(runs, at)
    counted = run_features(runs, metrics, at).agg(
        F.count_if(F.col("psi") >= severe).alias("severe_features"),
        F.count_if((F.col("psi") >= warn) & (F.col("psi") < severe)).alias("warning_features"),
    )
    return latest.select(
        "run_id", "sample_count", "max_psi", "overall_status", "prediction_psi"
    ).crossJoin(F.broadcast(counted))  # one row each
