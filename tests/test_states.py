"""Baselines merged from hourly states against the same baseline from the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltmark.config import CATEGORICAL, Feature
from siltmark.operators.longform import to_long_numerical
from siltmark.operators.states import COUNTS, StateStore, hourly_states, measured_rank_error, rank_error
from siltmark.sources.manifest import Manifest

FEATURES = [Feature("amount"), Feature("ticks"), Feature("nothing"), Feature("kind", CATEGORICAL)]
SPAN = ("2026-01-01 03:00:00", "2026-01-02 20:00:00")


def log(spark, n=60_000):
    """Skewed amounts, whole numbers with a hot value, an empty feature; a third of all rows in one hour."""
    spread = F.pmod(F.xxhash64("id"), F.lit(100_000)).cast("double") / 100_000
    hour = F.when(F.col("id") % 3 == 0, 10).otherwise(F.pmod(F.col("id"), F.lit(60)))
    return spark.range(n).select(
        "id", (F.lit("2026-01-01").cast("timestamp") + F.make_interval(hours=hour.cast("int"), mins=(F.col("id") % 60).cast("int"))).alias("timestamp"),
        F.when(F.col("id") % 7 != 0, F.exp(spread * 9)).alias("amount"),
        F.when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise(F.floor(spread * 1000)).alias("ticks"),
        F.lit(None).cast("double").alias("nothing"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("k"), (F.col("id") % 13).cast("string"))).alias("kind"),
    )


def inside(rows):
    at = F.col("timestamp")
    return rows.filter((at >= F.lit(SPAN[0]).cast("timestamp")) & (at < F.lit(SPAN[1]).cast("timestamp")))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Rows in three batches over the same hours; one comes twice."""
    out = StateStore(spark, str(tmp_path_factory.mktemp("states")))
    for batch in (0, 1, 2, 1):
        out.add(f"batch-{batch}", log(spark).filter(F.col("id") % 5 % 3 == batch), FEATURES)
    return out


def test_merged_states_equal_the_rows(spark, store):
    rows = inside(log(spark))
    v = F.col("value")
    exact = {r["feature"]: r for r in to_long_numerical(rows, FEATURES).groupBy("feature").agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count_distinct(v).alias("distinct")).collect()}
    got = {r["feature"]: r for r in store.numerical_baseline(*SPAN).collect()}
    assert set(got) == set(exact) == {"amount", "ticks", "nothing"}
    for name, row in got.items():
        assert [row[c] for c in ("n", "missing", "min", "max")] == [exact[name][c] for c in ("n", "missing", "min", "max")]
        if name != "nothing":
            assert row["mean"] == pytest.approx(exact[name]["mean"], rel=1e-12) and row["std"] == pytest.approx(exact[name]["std"], rel=1e-9)
            assert abs(row["distinct_estimate"] - exact[name]["distinct"]) <= 0.07 * exact[name]["distinct"]
    assert got["nothing"]["quantiles"] is None and got["nothing"]["mean"] is None


def test_rank_error_is_within_the_published_bound(spark, store):
    merged = store.numerical_baseline(*SPAN)
    off = {r["feature"]: r["rank_error"] for r in measured_rank_error(inside(log(spark)), FEATURES, merged).collect()}
    assert off["nothing"] is None and max(off["amount"], off["ticks"]) <= 2 * rank_error()


def test_measured_rank_error_sees_wrong_quantiles(spark):
    rows = spark.range(1, 1001).select(F.col("id").cast("double").alias("amount"))
    shifted = spark.createDataFrame([("amount", [float(100 * i + 50) for i in range(11)])], "feature string, quantiles array<double>")
    assert measured_rank_error(rows, FEATURES, shifted).first()["rank_error"] == pytest.approx(0.05, abs=0.002)


def test_category_shares_are_exact(spark, store):
    want = {r["kind"]: r["count"] for r in inside(log(spark)).filter("kind IS NOT NULL").groupBy("kind").count().collect()}
    got = store.category_shares(*SPAN).collect()
    assert {r["category"]: r["count"] for r in got} == want and sum(r["share"] for r in got) == pytest.approx(1, abs=1e-4)


def test_only_batches_of_the_window_are_opened(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    store.add("old", spark.createDataFrame([("2026-01-01 05:10:00", 1.0)], "timestamp string, amount double"), FEATURES)
    store.add("new", spark.createDataFrame([("2026-01-03 05:10:00", 9.0), ("no time", 7.0)], "timestamp string, amount double"), FEATURES)
    assert len(store.read("2026-01-03 00:00:00", "2026-01-04 00:00:00")[0].inputFiles()) < len(store.read("2026-01-01", "2026-01-04")[0].inputFiles())
    row = store.numerical_baseline("2026-01-03 00:00:00", "2026-01-04 00:00:00").first()
    assert (row["n"], row["min"], row["bin_edges"]) == (1, 9.0, [8.0, 10.0])
    assert store.numerical_baseline("2027-01-01", "2027-01-02").count() == 0


def test_a_break_before_the_list_changes_nothing(spark, tmp_path, monkeypatch):
    store = StateStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("2026-01-01 05:10:00", 1.0)], "timestamp string, amount double")
    store.add("a", rows, FEATURES)
    with monkeypatch.context() as broken:
        broken.setattr(Manifest, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.add("a", rows.unionByName(rows), FEATURES)
    assert store.numerical_baseline("2026-01-01", "2026-01-02").first()["n"] == 1
    store.add("a", rows.unionByName(rows), FEATURES)
    assert store.numerical_baseline("2026-01-01", "2026-01-02").first()["n"] == 2


def test_no_rows_and_absent_features(spark):
    empty = spark.createDataFrame([], "timestamp timestamp, other double")
    states, counts = hourly_states(empty, FEATURES)
    assert states.count() == 0 and counts.count() == 0 and counts.columns == [c.split()[0] for c in COUNTS.split(", ")]
