"""Stored runs: all tables of a monitoring job become visible together, once per run id."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions.columns import inline_table
from siltmark.sources.manifest import Manifest

RUNS = "runs"


class RunStore:
    """Tables of runs below ``path``; the newest commit that has a run id owns the run, whatever older ones say.

    ``stage`` writes one table of a commit, ``commit`` publishes them. A repeated or corrected run is a new
    commit that takes its run ids over: nothing is doubled, and a job that breaks off leaves no trace for readers.
    """

    def __init__(self, spark: SparkSession, path: str, run_id: str = "run_id"):
        self.spark, self.path, self.run_id = spark, path, run_id
        self.manifest = Manifest(spark, path)

    def stage(self, df: DataFrame, name: str) -> tuple[str, DataFrame]:
        """The folder of a staged table and its rows, read from there."""
        folder = self.manifest.stage(df, name)
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}")

    def commit(self, folders: Mapping[str, str]) -> str:
        """Publish staged tables (name -> folder, ``runs`` among them); returns the commit's name."""
        if RUNS not in folders:
            raise ValueError(f"a commit needs the table {RUNS!r}")
        name = uuid.uuid4().hex
        self.manifest.publish(lambda now: [*now, {"commit": name, "seq": 1 + max((e["seq"] for e in now), default=0), **folders}])
        return name

    def _rows(self, name: str) -> DataFrame:
        parts = [
            self.spark.read.parquet(f"{self.path}/{e[name]}").withColumn("_commit", F.lit(e["commit"]))
            for e in self.manifest.latest()[1] if name in e
        ]
        if not parts:
            raise FileNotFoundError(f"no commit in {self.path} has a table {name!r}")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def owners(self) -> DataFrame:
        """``run_id, _commit``: which commit speaks for a run."""
        order = inline_table(self.spark, [(e["commit"], e["seq"]) for e in self.manifest.latest()[1]], "_commit string, _seq bigint")
        seen = self._rows(RUNS).select(self.run_id, "_commit").join(F.broadcast(order), "_commit")  # a row per commit
        return seen.groupBy(self.run_id).agg(F.max_by("_commit", "_seq").alias("_commit"))

    def read(self, name: str = RUNS) -> DataFrame:
        """The rows of a table that belong to the commit owning their run."""
        rows = self._rows(name)
        if len(self.manifest.latest()[1]) > 1:
            rows = rows.join(self.owners(), [self.run_id, "_commit"], "left_semi")
        return rows.drop("_commit")

    def fold(self) -> None:
        """Rewrite what readers see as one commit, so that the list stays short."""
        _, entries = self.manifest.latest()
        if len(entries) < 2:
            return
        names = sorted({k for e in entries for k in e if k not in ("commit", "seq")})
        one = {"commit": uuid.uuid4().hex, "seq": max(e["seq"] for e in entries)}
        one |= {n: self.stage(self.read(n), n)[0] for n in names}
        self.manifest.publish(lambda now: None if any(e not in now for e in entries) else [one, *[e for e in now if e not in entries]])
