"""The monitoring run: quality, gate, feature drift, prediction drift, verdict.

Works for one batch or, with ``keys``, for many windows and segments in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.config import Feature, Rules
from siltmark.functions.columns import unwrapped, wrapped
from siltmark.operators.drift import feature_drift, prediction_drift, psi_table
from siltmark.operators.longform import with_window
from siltmark.operators.quality import quality_report
from siltmark.operators.verdict import combine_runs, min_sample_gate, run_counts
from siltmark.sources.artifacts import load_baseline
from siltmark.sources.partitions import scan_window
from siltmark.sources.runs import RUNS, RunStore


@dataclass(frozen=True)
class DriftRun:
    """The tables of a run; all lazy."""

    runs: DataFrame
    metrics: DataFrame
    violations: DataFrame
    feature_quality: DataFrame
    prediction: DataFrame | None


def drift_run(
    cur: DataFrame,
    ref: DataFrame,
    features: Iterable[Feature],
    rules: Rules = Rules(),
    bins: DataFrame | None = None,
    keys: Sequence[str] = (),
    full: bool = True,
    p_values: bool = True,
    histograms: bool = False,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DriftRun:
    """Compare ``cur`` with the baseline ``ref``.

    ``full`` computes every statistic of the report, otherwise the index only.
    Metrics of runs below the sample gate are left out of the result. ``keep`` may store a table as it is made
    and return the stored rows; what follows is then computed from those.
    """
    features, keys = list(features), list(keys)
    found, quality, summary = quality_report(cur, features, rules, keys)
    found, quality = keep(found, "violations"), keep(quality, "feature_quality")
    gate = min_sample_gate(cur, keys, rules)
    if full:
        metrics = feature_drift(ref, cur, features, bins, rules, keys, p_values, histograms)
    else:
        metrics = psi_table(ref, cur, features, bins, rules, keys)
    ok = gate.filter("gate = 'OK'").select(*(keys or [F.lit(1).alias("_ok")]))
    if keys:
        metrics = unwrapped(wrapped(metrics, keys).join(wrapped(ok, keys), keys, "left_semi"), keys)
    else:
        metrics = metrics.join(F.broadcast(ok)).drop("_ok")  # one row or none
    metrics = keep(metrics, "metrics")
    prediction = None
    score = rules.prediction_column
    if score in cur.columns and score in ref.columns:
        prediction = keep(prediction_drift(ref, cur, score, rules, keys, p_values, histograms), "prediction")
    runs = combine_runs(gate, run_counts(metrics, keys), summary, prediction, keys, rules)
    return DriftRun(runs, metrics, found, quality, prediction)


def stored_run(
    spark: SparkSession,
    store: str,
    log: str,
    baseline: str,
    start: datetime | str,
    end: datetime | str,
    features: Iterable[Feature],
    rules: Rules = Rules(),
    hours: int = 6,
    baseline_id: str | None = None,
    time_col: str = "timestamp",
) -> RunStore:
    """The whole job: log of ``[start, end)`` against a stored baseline, every window a run with its complete report.

    Window scan, baseline, quality, gate, all statistics with p-values and histograms, verdict; the tables
    ``runs, metrics, violations, feature_quality, prediction`` are staged one by one, each from the ones before, and become
    visible by one commit of the run store. A run id is the number of its window since the epoch, so a repeated job replaces
    its runs and changes nothing. ``baseline_id`` is the newest version unless given.
    """
    features = list(features)
    bins, sample = load_baseline(spark, baseline, baseline_id)
    wanted = dict.fromkeys([time_col, *(f.name for f in features), rules.prediction_column])
    cur = scan_window(spark, log, start, end, [*wanted], inclusive_end=False, time_col=time_col)
    return store_run(RunStore(spark, store), cur, sample, features, rules, bins, hours, time_col)


def store_run(
    target: RunStore, cur: DataFrame, ref: DataFrame, features: Iterable[Feature], rules: Rules = Rules(),
    bins: DataFrame | None = None, hours: int = 6, time_col: str = "timestamp",
) -> RunStore:
    """Every window of ``cur`` as a run against ``ref`` (or stored ``bins`` and its sample), with the complete report, committed."""
    # Many statistics read both sides: their columns are staged once (listed by no commit).
    _, cur = target.stage(with_window(cur, time_col, f"{hours} hours"), "window")
    _, ref = target.stage(ref, "reference")
    folders: dict[str, str] = {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        folders[name], stored = target.stage(with_run_id(df, hours), name)
        return stored.drop("run_id", "created_at")

    run = drift_run(cur, ref, features, rules, bins, ["window_start"], True, True, True, keep)
    keep(run.runs, RUNS)
    target.commit(folders)
    return target


def with_run_id(df: DataFrame, hours: int = 6) -> DataFrame:
    """Run id and time of a windowed table: the window's number since the epoch, and its end."""
    return df.withColumns({
        "run_id": F.floor(F.unix_timestamp("window_start") / (hours * 3600)).cast("long"),
        "created_at": F.col("window_start") + F.expr(f"INTERVAL {hours} HOURS"),
    })
