"""Continuous counterparts: log sink, file ingest, window drift, quality, cooldown.

Every job takes a checkpoint folder, so a restarted query continues where it was.
Batches are published through a manifest that knows their numbers, which makes the
sinks idempotent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltmark.config import CATEGORICAL, Feature, Rules
from siltmark.operators.harmonize import harmonize
from siltmark.operators.longform import to_long_categorical, to_long_numerical
from siltmark.operators.psi import category_statistics, psi_component, smoothed
from siltmark.operators.quality import feature_quality, quality_counts, violations
from siltmark.functions.columns import rounded, unwrapped, wrapped
from siltmark.sources.ingest import LEDGER_SCHEMA, ingest_new_files, union_widened
from siltmark.sources.manifest import Manifest
from siltmark.sources.partitions import PARTITIONS, event_time, partition_columns


def _triggered(writer, trigger: str):
    """``availableNow`` (drain and stop) or a processing-time interval."""
    if trigger == "availableNow":
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


def stream_log_sink(
    logs: DataFrame, path: str, checkpoint: str, time_col: str | None = None,
    trigger: str = "15 seconds",
) -> StreamingQuery:
    """Append a stream of log records to hour partitions, exactly once.

    Partition by arrival time like the buffered writer, or by ``time_col``.
    """
    at = event_time(logs, time_col) if time_col else F.current_timestamp()
    writer = (
        logs.withColumns(partition_columns(at)).writeStream.format("parquet")
        .partitionBy(*PARTITIONS).option("path", path).option("checkpointLocation", checkpoint)
    )
    return _triggered(writer, trigger).start()


def stream_ingest_files(
    raw: DataFrame, mapping: dict, features: Iterable[Feature], path: str, checkpoint: str,
    trigger: str = "15 seconds", now: str | None = None,
) -> StreamingQuery:
    """New files as a stream: the file source remembers what it has read."""
    clean = harmonize(raw, mapping, list(features), now)
    writer = (
        clean.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _triggered(writer, trigger).start()


def _has_batch(entries: list[dict], batch_id: int) -> bool:
    return any(e["first"] <= batch_id <= e["last"] for e in entries)


def update_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer of update-mode rows: each batch is one folder of the manifest, once.

    A batch that is already listed, alone or folded with others, is a replay of the same rows and is left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        manifest = Manifest(batch.sparkSession, path)
        if _has_batch(manifest.latest()[1], batch_id):
            return
        folder = manifest.stage(batch.withColumn("batch_id", F.lit(batch_id).cast("long")), f"batch-{batch_id}")
        entry = {"folder": folder, "first": batch_id, "last": batch_id}
        manifest.publish(lambda now: None if _has_batch(now, batch_id) else [*now, entry])

    return write


def _last_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    keyed = wrapped(rows, keys)
    return unwrapped(keyed.groupBy(*keys).agg(F.max_by(F.struct("batch_id", *rest), "batch_id").alias("_v")).select(*keys, "_v.*"), keys)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], schema: str | None = None) -> DataFrame:
    """Final state of an update-mode sink: the last value per key, over listed folders only.

    ``schema`` (with ``batch_id long``) serves a sink that has no batch yet.
    """
    manifest = Manifest(spark, path)
    return _last_per_key(manifest.read([e["folder"] for e in manifest.latest()[1]], schema), list(keys)).drop("batch_id")


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> None:
    """Fold the batches listed now into one folder with one row per key.

    May run beside the stream and beside other compactions. Folded rows keep the number of their own batch and the new
    entry covers the numbers it replaces, so neither a replay nor a break between two steps loses or repeats
    a key. Folders no longer listed stay for readers of older versions until ``Manifest.vacuum``.
    """
    manifest = Manifest(spark, path)
    _, entries = manifest.latest()
    if len(entries) < 2:
        return
    folded = _last_per_key(manifest.read([e["folder"] for e in entries]), list(keys))
    first, last = min(e["first"] for e in entries), max(e["last"] for e in entries)
    one = {"folder": manifest.stage(folded, f"fold-{last}"), "first": first, "last": last}

    def change(now: list[dict]) -> list[dict] | None:
        if any(e not in now for e in entries):  # another compaction came first
            return None
        return [one, *[e for e in now if e not in entries]]

    manifest.publish(change)


def stream_ingest_contents(
    spark: SparkSession, pattern: str, mapping: dict, features: Iterable[Feature], path: str, checkpoint: str,
    trigger: str = "15 seconds", now: str | None = None,
) -> StreamingQuery:
    """Files matching ``pattern`` as a stream that takes every content once.

    Every trigger lists the files, so a file that changed under its old name is seen as well; a renamed or repeated
    file has a known content hash and gives no rows. Harmonized rows and the ledger of their hashes are staged first and
    become visible by one published version, with the number of the batch; a replayed batch finds its number and
    stops. A file that cannot be read is tried again with the next trigger.
    """
    features = list(features)

    def pull(beat: DataFrame, batch_id: int) -> None:
        session = beat.sparkSession
        manifest = Manifest(session, path)
        _, entries = manifest.latest()
        if _has_batch(entries, batch_id):
            return
        ledger = manifest.read([e["ledger"] for e in entries if "ledger" in e], LEDGER_SCHEMA)
        rows, after = ingest_new_files(session, pattern, ledger, by="content")
        entry = {"first": batch_id, "last": batch_id}
        if rows is not None:
            clean = harmonize(rows, mapping, features, now)
            entry |= {"folder": manifest.stage(clean, f"batch-{batch_id}"), "schema": clean.schema.json()}
            new = after.join(ledger.select("hash"), "hash", "left_anti").select(*[f.split()[0] for f in LEDGER_SCHEMA.split(", ")])
            entry["ledger"] = manifest.stage(new, f"ledger-{batch_id}")
        quiet = [e for e in entries if "folder" not in e]  # batches without files: one entry speaks for them

        def change(current: list[dict]) -> list[dict] | None:
            if _has_batch(current, batch_id):
                return None
            if rows is None and quiet and current and current[-1] == quiet[-1] and current[-1]["last"] == batch_id - 1:
                return [*current[:-1], {"first": current[-1]["first"], "last": batch_id}]
            return [*current, entry]

        manifest.publish(change)

    beats = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = beats.writeStream.foreachBatch(pull).option("checkpointLocation", checkpoint)
    return _triggered(writer, trigger).start()


def read_ingested(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all published batches of ``stream_ingest_contents``; types that differ between files are widened."""
    manifest = Manifest(spark, path)
    by_schema: dict[str, list[str]] = {}
    for e in manifest.latest()[1]:
        if "folder" in e:
            by_schema.setdefault(e["schema"], []).append(e["folder"])
    if not by_schema:
        return manifest.read([], schema)
    parts = [manifest.read(folders, T.StructType.fromJson(json.loads(kind))) for kind, folders in by_schema.items()]
    return reduce(union_widened, parts)


def stream_window_counts(
    logs: DataFrame,
    features: Iterable[Feature],
    edges: DataFrame,
    path: str,
    checkpoint: str,
    time_col: str = "timestamp",
    size: str = "6 hours",
    delay: str = "1 day",
    slide: str | None = None,
    keys: Sequence[str] = (),
    trigger: str = "15 seconds",
) -> StreamingQuery:
    """Bin and category counts per event-time window, updated batch by batch.

    State holds one counter per window, feature and bin. ``delay`` bounds how late
    a record may come; later ones are dropped and show in the query's progress.
    """
    features, keys = list(features), list(keys)
    late = logs.withColumn("_ts", event_time(logs, time_col)).withWatermark("_ts", delay)
    long = to_long_numerical(late, features, [*keys, "_ts"]).join(
        F.broadcast(edges.select("feature", "bin_edges")), "feature"
    )
    inner = F.slice("bin_edges", F.lit(2), F.greatest(F.size("bin_edges") - 2, F.lit(0)))
    bucket = F.size(F.filter(inner, lambda e: F.col("value") >= e)).cast("string")
    cells = long.select(
        *keys, "_ts", "feature", F.when(F.col("value").isNotNull(), bucket).alias("cell")
    )
    if any(f.type == CATEGORICAL for f in features):
        cells = cells.unionByName(
            to_long_categorical(late, features, [*keys, "_ts"])
            .select(*keys, "_ts", "feature", F.col("value").alias("cell"))
        )
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    counted = cells.groupBy(w.alias("_w"), *keys, "feature", "cell").agg(
        F.count(F.lit(1)).alias("count")
    ).select(F.col("_w.start").alias("window_start"), *keys, "feature", "cell", "count")
    writer = (
        counted.writeStream.outputMode("update").foreachBatch(update_sink(path))
        .option("checkpointLocation", checkpoint)
    )
    return _triggered(writer, trigger).start()


def window_psi_from_counts(
    counts: DataFrame, ref_counts: DataFrame, epsilon: float = 1e-4, keys: Sequence[str] = ()
) -> DataFrame:
    """Index per window from streamed numerical counts.

    ``ref_counts(feature, counts ARRAY, n)`` is the binned baseline. Windows are
    report-sized; empty bins come from the baseline's grid.
    """
    group = ["window_start", *keys, "feature"]
    base = ref_counts.select("feature", F.col("counts").alias("_ref"), F.col("n").alias("ref_n"))
    numbers = counts.join(F.broadcast(base.select("feature")), "feature", "left_semi")
    seen = numbers.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(
            F.when(F.col("cell").isNotNull(), F.struct(F.col("cell").try_cast("int"), F.col("count")))
        )).alias("_m"),
        F.coalesce(F.sum(F.when(F.col("cell").isNotNull(), F.col("count"))), F.lit(0)).alias("cur_n"),
    )
    joined = seen.join(F.broadcast(base), "feature")
    k = F.size("_ref")
    zero = F.lit(0).cast("long")
    parts = F.transform("_ref", lambda r, i: psi_component(
        smoothed(F.coalesce(F.try_element_at("_m", i), zero), F.col("cur_n"), k, epsilon),
        smoothed(r, F.col("ref_n"), k, epsilon),
    ))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    psi = F.when((F.col("cur_n") > 0) & (F.col("ref_n") > 0), total).otherwise(0.0)
    return joined.select(*group, rounded(psi, 5).alias("psi"), "ref_n", "cur_n")


def window_categorical_psi_from_counts(
    counts: DataFrame, ref_counts: DataFrame, categories: DataFrame | None = None, epsilon: float = 1e-4,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Index per window of streamed categorical counts against the baseline's ``category_counts``.

    A window has rows for its own categories only; baseline categories it lacks enter as sums, so a window costs as
    many rows as it has categories however large the vocabulary is.
    """
    named = ref_counts.select("feature").distinct()  # one row per catalogued feature
    cells = counts.join(F.broadcast(named), "feature", "left_semi").select(
        "window_start", *keys, "feature", F.col("cell").alias("value"), "count",
        F.when(F.col("cell").isNotNull(), F.col("count")).otherwise(0).alias("known"),
    )
    group = ["window_start", *keys]
    cells = wrapped(cells, group)
    found = category_statistics(ref_counts, cells, categories, epsilon, group)
    return unwrapped(found, group).select(*group, "feature", "psi", "ref_n", "cur_n")


def stream_quality(
    logs: DataFrame, features: Iterable[Feature], path: str, checkpoint: str,
    time_col: str = "timestamp", size: str = "6 hours", delay: str = "1 day",
    trigger: str = "15 seconds",
) -> StreamingQuery:
    """Quality counts per event-time window, updated batch by batch."""
    late = logs.withColumn("_ts", event_time(logs, time_col)).withWatermark("_ts", delay)
    windowed = late.withColumn("_w", F.window("_ts", size))
    counted = quality_counts(windowed, list(features), ["_w"]).withColumn(
        "window_start", F.col("_w.start")
    ).drop("_w")
    writer = (
        counted.writeStream.outputMode("update").foreachBatch(update_sink(path))
        .option("checkpointLocation", checkpoint)
    )
    return _triggered(writer, trigger).start()


def quality_violations_from_counts(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    keys = ["window_start"]
    return violations(feature_quality(counts, rules, keys), rules, keys)


def _cooldown(
    key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Deliver a candidate unless the key's cooldown (in microseconds) still runs."""
    if state.hasTimedOut:
        state.remove()
        return
    until = state.get[0] if state.exists else None
    pdf = pd.concat(list(batches)).sort_values("candidate_at", kind="stable")
    delivered = []
    for at, hours in zip(pdf["candidate_at"], pdf["cooldown_hours"]):
        now = int(at.value // 1000)
        send = until is None or until <= now
        if send:
            until = now + int(hours) * 3_600_000_000
        delivered.append(send)
    state.update((until,))
    # Past this time the key can only be delivered anew, which needs no state.
    state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    yield pdf.assign(delivered=delivered)


def stream_alert_cooldown(
    candidates: DataFrame, path: str, checkpoint: str, trigger: str = "15 seconds", delay: str = "1 day"
) -> StreamingQuery:
    """Cooldown as keyed state: one timestamp per deduplication key, kept until the cooldown and ``delay`` are over.

    A batch holds the candidates of the runs that just ended, so the rows of one
    key in one batch are few.
    """
    schema = T.StructType([*candidates.schema.fields, T.StructField("delivered", T.BooleanType())])
    marked = candidates.withWatermark("candidate_at", delay).groupBy("dedup_key").applyInPandasWithState(
        _cooldown, schema, "until long", "append", GroupStateTimeout.EventTimeTimeout
    )
    writer = (
        marked.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    return _triggered(writer, trigger).start()
