"""Stored artifacts: baselines and reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.columns import inline_table
from siltmark.sources.manifest import Manifest


def save_baseline(
    bins: DataFrame, sample: DataFrame, path: str, baseline_id: str, dataset: str | None = None, created_at: datetime | None = None
) -> str:
    """Two Parquet tables below ``path``, published together as a version with its description.

    The description holds dataset name, time, and the numbers of features and sample rows. Saving an id again replaces
    that version for readers; the rows of the old one stay until ``Manifest.vacuum``.
    """
    manifest = Manifest(bins.sparkSession, path)
    entry = {"baseline_id": baseline_id, "bins": manifest.stage(bins, "bins"), "sample": manifest.stage(sample, "sample")}
    entry |= {
        "dataset": dataset, "created_at": (created_at or datetime.now(timezone.utc)).isoformat(),
        "n_features": manifest.read([entry["bins"]]).count(), "sample_rows": manifest.read([entry["sample"]]).count(),
    }
    manifest.publish(lambda now: [*[e for e in now if e["baseline_id"] != baseline_id], entry])
    return path


def baseline_versions(spark: SparkSession, path: str) -> DataFrame:
    """The description of every stored version, oldest first."""
    fields = ["baseline_id", "dataset", "created_at", "n_features", "sample_rows"]
    rows = [tuple(e[f] for f in fields) for e in Manifest(spark, path).latest()[1]]
    return inline_table(spark, rows, "baseline_id string, dataset string, created_at string, n_features bigint, sample_rows bigint")


def load_baseline(spark: SparkSession, path: str, baseline_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(bins, sample)`` of a version, the newest unless one is named."""
    manifest = Manifest(spark, path)
    entries = [e for e in manifest.latest()[1] if baseline_id in (None, e["baseline_id"])]
    if not entries:
        raise FileNotFoundError(f"no baseline {baseline_id or ''} in {path}")
    return tuple(manifest.read([entries[-1][n]]) for n in ("bins", "sample"))


def write_report(reports: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Append nested run reports, as Parquet or JSON."""
    reports.write.mode("append").format(fmt).save(path)
    return path


def read_report(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` taking over equal keys (table rewrite)."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.select(*[F.col(c) for c in old.columns]))
