"""Registered queries: streaming jobs drained with ``availableNow`` and read back."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from siltmark.functions.columns import rounded
from siltmark.operators.binning import category_counts, histogram_arrays, quantile_bin_edges
from siltmark.operators.longform import to_long_categorical, to_long_numerical
from siltmark.plans import twins as S
from siltmark.plans.datasets import EVENTS, EVENTS_SIDES_SQL, events_sides, log_columns
from siltmark.plans.queries_ingest import HARMONIZED, NOW, ORDER_FEATURES, ORDER_MAPPING
from siltmark.plans.queries_runs import QUALITY_SQL, REPLAY_SQL, RULES, candidates
from siltmark.plans.registry import query, table
from siltmark.sources.workspace import stored, workspace
from siltmark.streaming import jobs


def stream(spark, sf_dir, name):
    """A driver table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    )


def current_stream(spark, sf_dir):
    cut = F.lit("2024-01-09 00:00:00").cast("timestamp")
    return log_columns(stream(spark, sf_dir, "events")).filter(F.col("timestamp") >= cut)


@query("stream_log_sink", "SELECT event_id, event_type, user_id FROM events")
def stream_log_sink(spark, sf_dir):
    base = workspace(spark, "log-sink")
    logs = stream(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    q = jobs.stream_log_sink(logs, f"{base}/logs", f"{base}/checkpoint", trigger="availableNow")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/logs").select("event_id", "event_type", "user_id")


@query("stream_ingest", f"""
WITH {HARMONIZED} SELECT request_id, source_id, round(amount, 6) + 0.0 AS amount, urgency, region FROM h""")
def stream_ingest(spark, sf_dir):
    base = workspace(spark, "file-ingest")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the broken derivation is part of the case
        q = jobs.stream_ingest_files(
            stream(spark, sf_dir, "orders"), ORDER_MAPPING, ORDER_FEATURES,
            f"{base}/rows", f"{base}/checkpoint", "availableNow", NOW,
        )
    q.awaitTermination()
    rows = spark.read.parquet(f"{base}/rows")
    return rows.select(
        "request_id", "source_id", rounded(F.col("amount"), 6).alias("amount"), "urgency", "region"
    )


def repeat_file(spark, source, target, move=False):
    """The same bytes under another name, beside the old one or in its place."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    old, new = hadoop.Path(source), hadoop.Path(target)
    files = new.getFileSystem(conf)
    done = files.rename(old, new) if move else hadoop.FileUtil.copy(files, old, files, new, False, conf)
    if not done:
        raise OSError(f"{source} could not be {'renamed' if move else 'copied'} to {target}")


@query("stream_ingest_contents", """
SELECT o_orderkey::VARCHAR AS request_id, round(o_totalprice / 100.0, 6) + 0.0 AS amount, 'orders_export' AS source_id FROM orders""")
def stream_ingest_contents(spark, sf_dir):
    """The orders in three files, one of them twice; then one changes its name: every row is taken once."""
    base = workspace(spark, "content-ingest")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_totalprice", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey"
    )
    orders.repartition(3, "o_orderkey").write.parquet(f"{base}/in/first")
    # Rows written twice are not the same bytes: their order, and that of sets in the footer, depends on the executor.
    names = sorted(r[0] for r in spark.read.format("binaryFile").load(f"{base}/in/first/*.parquet").select("path").collect())
    repeat_file(spark, names[0], f"{base}/in/again/copy.parquet")
    for step in range(2):
        if step:
            repeat_file(spark, names[-1], f"{base}/in/first/renamed.parquet", move=True)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # the broken derivation is part of the case
            jobs.stream_ingest_contents(
                spark, f"{base}/in/*/*.parquet", ORDER_MAPPING, ORDER_FEATURES, f"{base}/out", f"{base}/checkpoint", "availableNow", NOW
            ).awaitTermination()
    rows = jobs.read_ingested(spark, f"{base}/out")
    return rows.select("request_id", rounded(F.col("amount"), 6).alias("amount"), "source_id")


def window_counts(spark, sf_dir):
    """Streamed counts per window, compacted, with the reference in long form and the edges."""
    base = workspace(spark, "window-drift")
    ref, _ = events_sides(spark, sf_dir)
    long = to_long_numerical(ref, EVENTS)
    # One row per feature, written once: every micro-batch and the final index would rank the whole reference again.
    edges = stored(quantile_bin_edges(long), "edges")
    q = jobs.stream_window_counts(
        current_stream(spark, sf_dir), EVENTS, edges, f"{base}/counts", f"{base}/checkpoint",
        trigger="availableNow",
    )
    q.awaitTermination()
    keys = ["window_start", "feature", "cell"]
    jobs.compact(spark, f"{base}/counts", keys)
    return jobs.read_latest(spark, f"{base}/counts", keys), ref, long, edges


@query("stream_window_drift", f"""
WITH {EVENTS_SIDES_SQL},{S.psi_numerical_ctes('ref', 'cur', ['value', 'k'], ['window_start'])},
{S.psi_sum_sql(['window_start'])},{S.category_ctes('ref', 'cur', ['event_type'], ['window_start'])},{S.psi_cat_sum_sql(['window_start'])}
SELECT window_start, feature, psi, ref_n, cur_n FROM psi_num
UNION ALL SELECT window_start, feature, psi, ref_n, cur_n FROM psi_cat""")
def stream_window_drift(spark, sf_dir):
    counts, ref, long, edges = window_counts(spark, sf_dir)
    categories = category_counts(to_long_categorical(ref, EVENTS))
    numbers = jobs.window_psi_from_counts(counts, histogram_arrays(long, edges, 10))
    return numbers.unionByName(jobs.window_categorical_psi_from_counts(counts, categories))


@query("stream_quality", f"""
WITH {EVENTS_SIDES_SQL},{QUALITY_SQL} SELECT * FROM viol""")
def stream_quality(spark, sf_dir):
    base = workspace(spark, "quality")
    q = jobs.stream_quality(
        current_stream(spark, sf_dir), EVENTS, f"{base}/counts", f"{base}/checkpoint",
        trigger="availableNow",
    )
    q.awaitTermination()
    counts = jobs.read_latest(spark, f"{base}/counts", ["window_start", "feature"])
    return jobs.quality_violations_from_counts(counts, RULES).drop("message")


@query("stream_cooldown", f"""
WITH RECURSIVE {REPLAY_SQL}
SELECT dedup_key, run_id, feature_name, candidate_at, cooldown_hours, delivered FROM replayed""")
def stream_cooldown(spark, sf_dir):
    """The alert history arrives in three parts; the state carries cooldowns across them."""
    base = workspace(spark, "cooldown")
    every = candidates(spark, sf_dir).select(
        "dedup_key", "run_id", "feature_name", "candidate_at", "cooldown_hours"
    )
    every.write.parquet(f"{base}/all")
    every = spark.read.parquet(f"{base}/all")
    first, last = every.agg(F.min("candidate_at"), F.max("candidate_at")).first()
    parts = 3
    for k in range(parts):  # each part arrives while the state of the ones before is kept
        low, high = (F.lit(first + (last - first) * j / parts) for j in (k, k + 1))
        at = F.col("candidate_at")
        part = every.filter((at >= low) & ((at <= high) if k == parts - 1 else (at < high)))
        part.write.mode("append").parquet(f"{base}/history")
        history = spark.readStream.schema(every.schema).parquet(f"{base}/history")
        q = jobs.stream_alert_cooldown(history, f"{base}/out", f"{base}/checkpoint", "availableNow")
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out")
