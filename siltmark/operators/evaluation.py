"""Binary classification metrics, champion/challenger gate, detector backtest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions.columns import nan_to_null, rounded
from siltmark.functions.ordered import running_totals


def ranking_metrics(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Unrounded ``keys, rows, positives, roc_auc, pr_auc``.

    Scores are counted per distinct value; running totals over them give the rank
    statistic (ties averaged) and the precision at each threshold. Rows without a score or
    label (NULL or NaN) take no part and are not in ``rows``.
    """
    keys = list(keys)
    y = F.col(label).cast("long")
    counts = df.filter(nan_to_null(F.col(score).cast("double")).isNotNull() & y.isNotNull()).groupBy(
        *keys, (-nan_to_null(F.col(score).cast("double"))).alias("value")
    ).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    # From the highest score down the running totals are the hits and false alarms of each threshold, so no row needs
    # the totals of its model: P and N_ are sums beside the others.
    cum = running_totals(counts, keys, ["pos", "neg"], range_group=keys)
    hits, false = F.col("cum_pos"), F.col("cum_neg")
    agg = cum.groupBy(*keys).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N_"),
        F.sum(F.col("pos") * (false - F.col("neg") / 2.0)).alias("_above"),
        F.sum(F.col("pos") * (hits / (hits + false))).alias("_ap"),
    )
    if not keys:  # without rows the one group is empty
        agg = agg.filter("P IS NOT NULL")
    agg = agg.withColumn("_u", F.col("P").cast("double") * F.col("N_") - F.col("_above"))
    single = (F.col("P") == 0) | (F.col("N_") == 0)
    rows = F.col("P") + F.col("N_")
    # Nested WHENs keep the divisions away from empty classes.
    auc = F.when(single, F.lit(0.5)).otherwise(
        F.col("_u") / F.nullif(F.col("P").cast("double") * F.col("N_"), F.lit(0.0))
    )
    ap = F.when(single, F.col("P") / rows).otherwise(
        F.col("_ap") / F.nullif(F.col("P").cast("double"), F.lit(0.0))
    )
    return agg.select(
        *keys, rows.alias("rows"), F.col("P").alias("positives"),
        auc.alias("roc_auc"), ap.alias("pr_auc"),
    )


def threshold_metrics(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Unrounded ``keys, f1_score, log_loss``: F1 at 0.5 and mean log loss of clipped scores, over scored rows."""
    y, s = F.col(label) == 1, nan_to_null(F.col(score).cast("double"))
    hit = s >= 0.5
    p = F.least(F.greatest(s, F.lit(1e-6)), F.lit(1.0 - 1e-6))
    loss = F.when(y, -F.ln(p)).otherwise(-F.ln(1.0 - p))
    agg = df.filter(s.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count_if(y & hit).alias("_tp"), F.count_if(~y & hit).alias("_fp"),
        F.count_if(y & ~hit).alias("_fn"), F.avg(loss).alias("log_loss"),
    )
    size = 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")
    f1 = F.when(size > 0, 2 * F.col("_tp") / F.nullif(size, F.lit(0))).otherwise(0.0)
    return agg.select(*keys, f1.alias("f1_score"), "log_loss")


def binary_metrics(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ("model",)
) -> DataFrame:
    """``keys, roc_auc, pr_auc, f1_score, log_loss``, four decimals."""
    keys = list(keys)
    rank = ranking_metrics(df, score, label, keys)
    cut = threshold_metrics(df, score, label, keys)
    both = rank.join(cut, keys) if keys else rank.crossJoin(F.broadcast(cut))
    names = ("roc_auc", "pr_auc", "f1_score", "log_loss")
    return both.select(*keys, *[rounded(F.col(c), 4).alias(c) for c in names])


# What a missing champion counts as.
NO_CHAMPION = {"roc_auc": 0.5, "pr_auc": 0.5, "f1_score": 0.0, "log_loss": 1.0}


def champion_challenger(
    metrics: DataFrame,
    champion: str | None = "champion",
    challenger: str = "challenger",
    tolerance: float = 0.03,
) -> DataFrame:
    """One verdict row from ``binary_metrics`` rows of both models.

    APPROVED when the challenger's ROC-AUC is at most ``tolerance`` below the
    champion's, or when there is no champion.
    """
    names = list(NO_CHAMPION)

    def side(model: str | None, c: str) -> Column:
        value = F.max(F.when(F.col("model") == model, F.col(c))) if model else F.lit(None)
        return F.coalesce(value, F.lit(NO_CHAMPION[c])) if model == champion else value

    present = F.max(F.when(F.col("model") == champion, F.lit(True))) if champion else F.lit(None)
    one = metrics.agg(
        present.alias("_has"),
        *[side(champion, c).cast("double").alias(f"champion_{c}") for c in names],
        *[side(challenger, c).cast("double").alias(f"challenger_{c}") for c in names],
    )
    delta = F.col("challenger_roc_auc") - F.col("champion_roc_auc")
    ok = F.col("_has").isNull() | (rounded(delta, 9) >= -tolerance)
    return one.select(
        *one.columns[1:],
        *[rounded(F.col(f"challenger_{c}") - F.col(f"champion_{c}"), 4).alias(f"delta_{c}")
          for c in ("roc_auc", "f1_score", "log_loss")],
        F.when(ok, "APPROVED").otherwise("REJECTED").alias("verdict"),
        F.when(F.col("_has").isNull(), "no champion to compare against")
        .when(ok, "challenger within tolerance of champion")
        .otherwise("challenger degraded beyond tolerance").alias("reason"),
    )


def drift_episodes(
    series: DataFrame, labels: DataFrame, threshold: float = 0.20, on: Sequence[str] = ("window_start",), window_hours: float = 6.0
) -> DataFrame:
    """One row per episode: a run of labelled windows without a gap, with its onset, first hit and delay.

    ``on`` names the time column first, then segments. An episode ends where a window is clean or missing. The delay is the time
    from the onset to the end of the first window in the episode whose index reaches the threshold, NULL if none does.
    """
    at, *segments = on
    order = Window.partitionBy(*segments).orderBy(at)  # a row per run of the report
    hours = F.expr(f"make_dt_interval(0, 0, 0, {window_hours * 3600})")
    judged = series.join(labels, list(on)).withColumn("_hit", F.coalesce(F.col("psi") >= threshold, F.lit(False)))
    drifted = judged.filter("drifted").withColumn("_new", F.coalesce(F.lag(at).over(order) + hours < F.col(at), F.lit(True)).cast("int"))
    numbered = drifted.withColumn("episode", F.sum("_new").over(order).cast("int"))
    first = F.min(F.when(F.col("_hit"), F.col(at)))
    return numbered.groupBy(*segments, "episode").agg(
        F.min(at).alias("onset"), (F.max(at) + hours).alias("end"), F.count(F.lit(1)).alias("windows"), first.alias("first_hit"),
    ).withColumn(
        "delay_hours", rounded((F.unix_timestamp(F.col("first_hit") + hours) - F.unix_timestamp("onset")) / 3600.0, 4)
    )


def detector_backtest(
    series: DataFrame,
    labels: DataFrame,
    threshold: float = 0.20,
    on: Sequence[str] = ("window_start",),
    window_hours: float = 6.0,
) -> DataFrame:
    """How well ``psi >= threshold`` finds windows labelled ``drifted``.

    ``false_alarm_rate_pct``, ``sensitivity_pct``, ``episodes``, ``detected_episodes`` and ``detection_delay_hours``: the mean
    measured time from the onset of an episode of drifted windows to the end of the run that found it, over the
    episodes found; NULL if none was.
    """
    found = drift_episodes(series, labels, threshold, on, window_hours).agg(
        F.count(F.lit(1)).alias("episodes"), F.count("first_hit").alias("detected_episodes"),
        rounded(F.avg("delay_hours"), 4).alias("detection_delay_hours"),
    )
    judged = series.join(labels, list(on)).withColumn("_hit", F.col("psi") >= threshold)
    drifted = F.col("drifted")
    return judged.agg(
        F.count_if(~drifted).alias("clean_windows"), F.count_if(drifted).alias("drifted_windows"),
        F.count_if(~drifted & F.col("_hit")).alias("false_alarms"),
        F.count_if(drifted & F.col("_hit")).alias("detected"),
    ).select(
        "clean_windows", "drifted_windows", "false_alarms", "detected",
        rounded(F.col("false_alarms") * 100.0 / F.greatest("clean_windows", F.lit(1)), 2)
        .alias("false_alarm_rate_pct"),
        rounded(F.col("detected") * 100.0 / F.greatest("drifted_windows", F.lit(1)), 2)
        .alias("sensitivity_pct"),
    ).crossJoin(F.broadcast(found))  # one row each
