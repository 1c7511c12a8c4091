"""Statistical operators on small frames against independent numpy formulations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltmark.config import CATEGORICAL, Feature, Rules
from siltmark.functions import ordered
from siltmark.functions.ordered import exact_quantiles, running_totals
from siltmark.operators import baseline, binning, chi2, drift, ks, profile, psi
from siltmark.operators.evaluation import ranking_metrics
from siltmark.operators.longform import to_long_numerical
from siltmark.plans.drift_run import drift_run

X, C = Feature("x"), Feature("c", CATEGORICAL)


def frame(spark, values, name="x", kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def index_by_hand(ref, cur, edges, eps=1e-4):
    """Counts by bisection, shares and the sum in plain Python."""
    def shares(values):
        count = [0] * (len(edges) - 1)
        for slot in np.searchsorted(edges[1:-1], values, side="right"):
            count[slot] += 1
        return [(n + eps) / (len(values) + len(count) * eps) for n in count]

    return sum((p - q) * (math.log(p) - math.log(q)) for p, q in zip(shares(cur), shares(ref)))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = {
        "normal": rng.normal(100, 15, 2000), "ties": rng.integers(0, 4, 500).astype(float),
        "constant": np.full(50, 3.25), "single": np.array([7.0]), "pair": np.array([1.0, 2.0]),
        "sentinel": np.append(rng.lognormal(0, 2, 800), [1e308, -1e308, 0.0]),
        "shifted": 1.7e9 + rng.random(700), "tiny": rng.random(300) * 1e-12,
    }
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("normal", None)]
    df = spark.createDataFrame(rows, "feature string, value double").repartition(7)
    probs = [i / 10 for i in range(11)] + [0.333]
    got = {r["feature"]: r for r in exact_quantiles(
        df, probs, ["feature"], range_group=["feature"], bounded=True).collect()}
    for name, vs in data.items():
        assert got[name]["n"] == len(vs)
        np.testing.assert_allclose(got[name]["quantiles"], np.quantile(vs, probs), rtol=1e-12)


def test_running_totals(spark):
    rng = np.random.default_rng(6)
    values = np.unique(np.concatenate([rng.normal(0, 1, 900), [1e300, -1e300, np.inf, -np.inf]]))
    rows = [(g, float(v), int(i % 5)) for g in ("a", "b") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, value double, n long")
    out = running_totals(df, ["g"], ["n"], range_group=["g"])
    got = sorted((r["g"], r["value"], r["cum_n"]) for r in out.collect())
    totals = np.cumsum([i % 5 for i in range(len(values))]).tolist()
    assert got == [(g, float(v), t) for g in ("a", "b") for v, t in zip(values, totals)]


def test_same_distribution_is_stable(spark):
    rng = np.random.default_rng(1)
    ref, cur = rng.normal(100, 15, 2000), rng.normal(100, 15, 2000)
    r, c = frame(spark, ref.tolist()), frame(spark, cur.tolist())
    row = one(psi.psi_numerical(r, c, [X]))
    assert row["psi"] < 0.05
    parts = psi.psi_breakdown(r, c, [X]).collect()
    assert len(parts) == 10
    assert sum(p["production_pct"] for p in parts) == pytest.approx(1, abs=1e-3)
    labels = [p["label"] for p in sorted(parts, key=lambda p: p["bin"])]
    assert labels[0].startswith("[-inf, ") and labels[-1].endswith(", +inf]")


def test_shift_equals_independent_formula(spark):
    rng = np.random.default_rng(2)
    ref, cur = rng.normal(50, 10, 1500), rng.normal(65, 12, 1200)
    row = one(psi.psi_numerical(frame(spark, ref.tolist()), frame(spark, cur.tolist()), [X]))
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))
    assert row["psi"] == pytest.approx(index_by_hand(ref, cur, edges), rel=1e-3)
    assert row["psi"] > 0.20


def test_fixed_edges_and_empty_bins(spark):
    edges = spark.createDataFrame(
        [("x", [2.0, 9.0, 17.0, 40.0, 64.0])], "feature string, bin_edges array<double>"
    )
    ref = [2.5 * k + 1 for k in range(24)]
    cur = [0.8 * v + 4 for v in ref]
    row = one(psi.psi_numerical(frame(spark, ref), frame(spark, cur), [X], bins=edges))
    assert row["psi"] == pytest.approx(index_by_hand(ref, cur, [2, 9, 17, 40, 64]), abs=1e-5)
    hist = binning.histogram_by_edges(to_long_numerical(frame(spark, ref), [X]), edges)
    got = [r["count"] for r in hist.orderBy("bin").collect()]
    assert got == np.bincount(np.searchsorted([9, 17, 40], ref, side="right"), minlength=4).tolist()
    few = [4.0, 5.0] * 40
    wide = [k / 7 for k in range(300)]
    row = one(psi.psi_numerical(frame(spark, wide), frame(spark, few), [X], num_bins=5))
    assert math.isfinite(row["psi"]) and row["psi"] > 0.20


def test_stored_edges_may_have_any_number_of_bins(spark):
    marks = [float(i) for i in range(20)]
    edges = spark.createDataFrame([("x", marks)], "feature string, bin_edges array<double>")
    r, c = [k * 0.37 for k in range(50)], [k * 0.31 for k in range(60)]
    left, right = frame(spark, r), frame(spark, c)
    want = pytest.approx(index_by_hand(r, c, marks), abs=1e-5)
    assert one(psi.psi_numerical(left, right, [X], bins=edges))["psi"] == want
    stored = edges.selectExpr("feature", "bin_edges", "'numerical' AS feature_type")
    assert one(drift.feature_drift(left, right, [X], bins=stored, p_values=False))["psi"] == want


def test_null_segment_and_absent_features_have_rows(spark):
    """A NULL segment is reported like any other, a declared feature without a column as stable."""
    rng = np.random.default_rng(12)
    ref = spark.createDataFrame([(float(v), "ab"[i % 2]) for i, v in enumerate(rng.normal(0, 1, 400))], "x double, c string")
    rows = [(s, float(v) + 2, "a") for v in rng.normal(0, 1, 200) for s in ("one", None)]
    cur = spark.createDataFrame(rows, "seg string, x double, c string")
    features = [X, C, Feature("gone"), Feature("also", CATEGORICAL)]
    rules = Rules(min_samples=10)
    for table in (
        drift.psi_table(ref, cur, features, keys=["seg"]), drift.feature_drift(ref, cur, features, keys=["seg"]),
        drift.segment_drift(ref, cur, features, "seg"),
    ):
        by = {(r["seg"], r["feature"]): r for r in table.collect()}
        assert len(by) == 8
        for name in ("x", "c", "gone", "also"):
            assert by[None, name]["psi"] == by["one", name]["psi"]
        assert by[None, "x"]["status"] == "DRIFT" and by[None, "gone"]["status"] == "STABLE"
    runs = {r["seg"]: r for r in drift_run(cur, ref, features, rules, keys=["seg"]).runs.collect()}
    assert runs[None]["overall_status"] == runs["one"]["overall_status"] == "DRIFT_DETECTED"
    assert runs[None]["max_psi"] == runs["one"]["max_psi"] > 0.2 and not runs[None]["quality_passed"]
    whole = {r["feature"]: r["status"] for r in drift.feature_drift(ref, cur, [Feature("gone")]).collect()}
    assert whole == {"gone": "STABLE"}


def test_invariants(spark):
    rng = np.random.default_rng(3)
    a = frame(spark, rng.normal(0, 1, 500).tolist())
    b = frame(spark, rng.normal(0.3, 1, 400).tolist())
    assert one(psi.psi_numerical(a, a, [X]))["psi"] == 0
    edges = binning.quantile_bin_edges(to_long_numerical(a, [X]))
    left = one(psi.psi_numerical(a, b, [X], bins=edges))["psi"]
    right = one(psi.psi_numerical(b, a, [X], bins=edges))["psi"]
    assert left == right
    d = one(ks.ks_two_sample(a, b, [X], p_value=None))["ks_statistic"]
    assert 0 <= d <= 1
    for parts in (1, 7):
        assert one(psi.psi_numerical(a.repartition(parts), b.repartition(parts), [X]))["psi"] == left


def test_degenerate_inputs(spark):
    constant, other = frame(spark, [5.0] * 20), frame(spark, [1.0, 9.0])
    row = one(psi.psi_numerical(constant, other, [X]))
    assert row["psi"] == 0 and row["degenerate_bins"]
    nothing = frame(spark, [None, None])
    row = one(psi.psi_numerical(constant, nothing, [X]))
    assert (row["psi"], row["cur_n"]) == (0, 0)
    row = one(ks.ks_two_sample(constant, nothing, [X]))
    assert (row["ks_statistic"], row["ks_p_value"]) == (0, 1)
    nan = frame(spark, [1.0, float("nan"), 2.0, float("inf"), -0.0, 0.0])
    got = one(profile.numeric_summary(nan, [X]))
    assert (got["missing"], got["n"], got["max"]) == (1, 5, float("inf"))
    duplicate = spark.createDataFrame(
        [("x", [1.0, 1.0, 2.0])], "feature string, bin_edges array<double>"
    )
    hist = binning.histogram_by_edges(to_long_numerical(frame(spark, [0.0, 1.0, 2.0]), [X]), duplicate)
    assert [r["count"] for r in hist.orderBy("bin").collect()] == [1, 2]


def ks_numpy(a, b):
    points = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), points, "right") / len(a)
    fb = np.searchsorted(np.sort(b), points, "right") / len(b)
    return float(np.abs(fa - fb).max())


def test_ks(spark):
    rng = np.random.default_rng(7)
    ref, same, moved = rng.normal(0, 1, 1000), rng.normal(0, 1, 1000), rng.normal(0.4, 1, 1000)
    quiet = one(ks.ks_two_sample(frame(spark, ref.tolist()), frame(spark, same.tolist()), [X]))
    loud = one(ks.ks_two_sample(frame(spark, ref.tolist()), frame(spark, moved.tolist()), [X]))
    assert quiet["ks_p_value"] > 0.05 > 0.01 > loud["ks_p_value"]
    assert loud["ks_statistic"] == pytest.approx(ks_numpy(ref, moved), abs=1e-5)


def test_ks_per_group_needs_no_copy_of_the_reference(spark):
    rng = np.random.default_rng(8)
    ref = np.round(rng.normal(0, 1, 300), 1)
    groups = {g: np.round(rng.normal(g / 3, 1, 50 + 20 * g), 1) for g in range(4)}
    cur = spark.createDataFrame(
        [(g, float(v)) for g, vs in groups.items() for v in vs] + [(9, None)], "g int, x double"
    )
    got = {r["g"]: r["d"] for r in ks.ks_statistic(
        frame(spark, ref.tolist()), cur, [X], ["g"]).collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(ks_numpy(ref, vs), abs=1e-12)
    assert got[9] == 0


def cats(spark, counts):
    return frame(spark, [k for k, n in counts.items() for _ in range(n)], "c", "string")


def test_categorical_psi(spark):
    ref = cats(spark, {"RENT": 45, "MORTGAGE": 40, "OWN": 15})
    cur = cats(spark, {"RENT": 75, "MORTGAGE": 20, "OWN": 5})
    assert one(psi.psi_categorical(ref, cur, [C]))["psi"] > 0.10


def test_unseen_category_goes_to_other(spark):
    ref = cats(spark, {"RENT": 100, "OWN": 100, "MORTGAGE": 100})
    cur = cats(spark, {"RENT": 100, "OWN": 100, "UNKNOWN_NEW_CAT": 100})
    listed = spark.createDataFrame(
        [("c", ["MORTGAGE", "OWN", "RENT"])], "feature string, categories array<string>"
    )
    rows = {r["label"]: r for r in psi.psi_breakdown(ref, cur, [C], categories=listed).collect()}
    assert set(rows) == {"MORTGAGE", "OWN", "RENT", "__OTHER__"}
    assert rows["__OTHER__"]["baseline_pct"] == 0
    assert rows["__OTHER__"]["production_pct"] == pytest.approx(1 / 3, abs=1e-5)
    eps, k = 1e-4, 4
    want = 0.0
    for r, c in ((100, 0), (100, 100), (100, 100), (0, 100)):
        q, p = (r + eps) / (300 + k * eps), (c + eps) / (300 + k * eps)
        want += (p - q) * math.log(p / q)
    assert one(psi.psi_categorical(ref, cur, [C], listed))["psi"] == pytest.approx(want, abs=1e-5)


def test_reference_values_outside_the_list_stay_in_the_total(spark):
    ref, cur = cats(spark, {"A": 50, "Z": 50}), cats(spark, {"A": 100})
    listed = spark.createDataFrame([("c", ["A"])], "feature string, categories array<string>")
    cells = psi.categorical_bins(ref, cur, [C], listed).collect()
    assert [(r["category"], r["ref_count"], r["ref_n"]) for r in cells] == [("A", 50, 100)]


def test_chi_square(spark):
    ref = cats(spark, {"A": 50, "B": 50})
    quiet = one(chi2.chi2_homogeneity(ref, cats(spark, {"A": 48, "B": 52}), [C]))
    loud = one(chi2.chi2_homogeneity(ref, cats(spark, {"A": 85, "B": 15}), [C]))
    assert quiet["chi2_p_value"] > 0.05 > 0.01 > loud["chi2_p_value"]
    # By hand: cells 51,51 / 86,16 with continuity correction.
    o = np.array([[51, 51], [86, 16]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert loud["chi2_statistic"] == pytest.approx((((abs(o - e) - 0.5) ** 2) / e).sum(), abs=1e-4)
    single = one(chi2.chi2_homogeneity(cats(spark, {"A": 5}), cats(spark, {"A": 9}), [C]))
    assert (single["chi2_statistic"], single["chi2_p_value"], single["dof"]) == (0, 1, 0)


# Published category counts of 750 baseline and 600 / 1100 current rows.
HOME = ("MORTGAGE", "OTHER", "OWN", "RENT")
INTENT = ("DEBTCONSOLIDATION", "EDUCATION", "HOMEIMPROVEMENT", "MEDICAL", "PERSONAL", "VENTURE")
HOME_REF, INTENT_REF = (328, 14, 81, 327), (144, 109, 104, 116, 198, 79)


@pytest.mark.parametrize("names, ref, cur, index, x, p", [
    (HOME, HOME_REF, (273, 11, 60, 256), 0.00152, 0.4884, 0.921432),
    (INTENT, INTENT_REF, (125, 87, 91, 93, 147, 57), 0.00499, 1.6446, 0.895807),
    (HOME, HOME_REF, (351, 15, 89, 645), 0.09123, 40.511, 0.0),
    (INTENT, INTENT_REF, (282, 115, 129, 297, 187, 90), 0.1472, 63.7392, 0.0),
])
def test_published_categorical_values(spark, names, ref, cur, index, x, p):
    r, c = cats(spark, dict(zip(names, ref))), cats(spark, dict(zip(names, cur)))
    assert one(psi.psi_categorical(r, c, [C]))["psi"] == index
    row = one(chi2.chi2_homogeneity(r, c, [C]))
    assert (row["chi2_statistic"], row["chi2_p_value"]) == (x, p)


# Published bin counts; bin i is entered as the value i + 0.5.
AGE_REF = (71, 75, 68, 73, 87, 55, 94, 76, 72, 79)
RATE_REF = (75, 75, 75, 74, 75, 75, 76, 75, 74, 76)


@pytest.mark.parametrize("ref, cur, index", [
    (AGE_REF, (49, 92, 53, 68, 58, 41, 74, 56, 49, 60), 0.03438),
    (RATE_REF, (62, 48, 49, 72, 65, 56, 64, 61, 62, 61), 0.01411),
    (AGE_REF, (96, 157, 95, 122, 106, 76, 140, 101, 97, 110), 0.02359),
    (RATE_REF, (62, 48, 49, 72, 65, 56, 64, 62, 68, 554), 0.89615),
])
def test_published_numerical_values(spark, ref, cur, index):
    edges = spark.createDataFrame(
        [("x", [float(i) for i in range(11)])], "feature string, bin_edges array<double>"
    )
    r, c = ([i + 0.5 for i, n in enumerate(counts) for _ in range(n)] for counts in (ref, cur))
    assert one(psi.psi_numerical(frame(spark, r), frame(spark, c), [X], bins=edges))["psi"] == index


def test_prediction_drift(spark):
    rng = np.random.default_rng(9)
    ref = frame(spark, rng.beta(2, 5, 500).tolist(), "prediction_score")
    cur = frame(spark, rng.beta(5, 2, 500).tolist(), "prediction_score")
    row = one(drift.prediction_drift(ref, cur))
    assert row["status"] == "DRIFT" and row["psi"] > 0.15 and row["ks_p_value"] < 0.05


def test_baseline(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({
        "id": range(500), "age": rng.integers(18, 80, 500).astype(float),
        "income": rng.lognormal(10, 1, 500), "home": rng.choice(["RENT", "OWN"], 500),
        "prediction_score": rng.random(500),
    })
    feats = [Feature("age"), Feature("income"), Feature("home", CATEGORICAL,
             allowed_values=("RENT", "OWN", "OTHER")), Feature("absent")]
    bins, sample = baseline.build_baseline(spark.createDataFrame(pdf), feats, ["id"], sample_size=100)
    rows = {r["feature"]: r for r in bins.collect()}
    assert set(rows) == {"age", "income", "home", "prediction_score"}
    edges = rows["income"]["bin_edges"]
    assert edges == sorted(edges) and len(edges) == 11
    assert sum(rows["income"]["baseline_percentages"]) == pytest.approx(1, abs=1e-4)
    assert rows["home"]["categories"] == ["OTHER", "OWN", "RENT"]
    assert rows["home"]["category_percentages"]["OTHER"] == 0
    assert rows["age"]["median"] == pytest.approx(np.median(pdf.age), abs=1e-3)
    assert rows["age"]["std"] == pytest.approx(np.std(pdf.age), abs=1e-3)
    assert sample.count() == 100
    everything = baseline.build_baseline(spark.createDataFrame(pdf), feats, ["id"])[1]
    assert everything.count() == 500


def test_feature_drift_columns_and_flags(spark):
    rng = np.random.default_rng(11)
    rows = [(float(v), "AB"[i % 2]) for i, v in enumerate(rng.normal(0, 1, 300))]
    moved = [(v + 1.0, "A") for v, _ in rows]
    schema = "x double, c string"
    table = drift.feature_drift(
        spark.createDataFrame(rows, schema), spark.createDataFrame(moved, schema), [X, C],
        histograms=True, rules=Rules(),
    )
    got = {r["feature"]: r for r in table.collect()}
    assert got["x"]["status"] == "DRIFT" and got["x"]["ks_significant"]
    assert got["c"]["status"] == "DRIFT" and got["c"]["chi2_significant"]
    assert got["c"]["current_top_category"] == "A" and got["c"]["current_unique_count"] == 1
    assert len(got["x"]["histogram"]["psi_components"]) == 10
    assert got["c"]["histogram"]["bin_labels"] == ["A", "B"]
    assert got["x"]["current_mean"] == pytest.approx(np.mean([v for v, _ in moved]), abs=0.01)


def test_all_null_category(spark):
    df = spark.createDataFrame([(None,), (None,)], "c string")
    row = one(profile.categorical_profile(df, [C]))
    assert (row["top_category"], row["unique_count"], row["missing_pct"]) == ("N/A", 0, 1)


def test_mode_takes_the_smallest_on_ties(spark):
    df = frame(spark, ["b", "a", "b", "a", "c"], "c", "string")
    assert one(profile.categorical_profile(df, [C]))["top_category"] == "a"


def test_window_tiles(spark):
    df = spark.createDataFrame(
        [("2024-01-01 05:59:59", 1.0), ("2024-01-01 06:00:00", 2.0)], "timestamp string, x double"
    )
    series = drift.window_drift_series(frame(spark, [1.0, 2.0]), df, [X])
    assert series.select("window_start").distinct().count() == 2
    assert {r["cur_n"] for r in series.collect()} == {1}


def test_approximate_mode(spark):
    long = to_long_numerical(frame(spark, [float(i) for i in range(101)]), [X])
    row = one(binning.quantile_bin_edges(long, accuracy=10_000))
    assert row["bin_edges"] == [float(i) for i in range(0, 101, 10)]


def test_running_totals_of_one_group_are_spread(spark):
    """One group is no reason for one task: neither where it meets its range nor in the windows behind."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "16")):
        spark.conf.set(k, v)
    try:
        counts = spark.range(20_000).selectExpr("concat('m', id % 1) AS model", "CAST(id % 10000 AS DOUBLE) AS value", "1L AS n").groupBy("model", "value").agg(
            F.sum("n").alias("n"))
        cum = running_totals(counts, ["model"], ["n"], range_group=["model"])
        met = ordered._with_ranges(counts, ordered.value_ranges(counts, ["model"]), ["model"], False)
        for df in (met, cum):
            sizes = [r[0] for r in df.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
            assert len(sizes) > 8 and max(sizes) < 2_500 and sum(sizes) == 10_000
        assert cum.filter("cum_n <> 2 * (value + 1)").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [["model"], []])
def test_ranking_metrics_equal_a_plain_count(spark, keys):
    rows = [("m", int(i * 7 % 11 < 4), (i * 37 % 50) / 10 - 2.0) for i in range(300)]
    got = ranking_metrics(spark.createDataFrame(rows, "model string, label int, score double"), "score", "label", keys).first()
    up, down = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down)
    ap = sum(sum(x >= s for x in up) / sum(x >= s for x in up + down) for s in up) / len(up)
    assert (got["rows"], got["positives"]) == (300, len(up))
    assert abs(got["roc_auc"] - auc) < 1e-12 and abs(got["pr_auc"] - ap) < 1e-12
    none = spark.createDataFrame([], "model string, label int, score double")
    assert ranking_metrics(none, "score", "label", keys).count() == 0


def test_bucket_counts_of_a_group_are_bounded(spark):
    """Offsets are computed per bucket: their rows must not grow with the distinct values of a group."""
    counts = spark.range(300_000).selectExpr("concat('m', id % 1) AS model", "ln(id + 1D) AS value", "1L AS n")
    placed = ordered._with_ranges(counts, ordered.value_ranges(counts, ["model"]), ["model"], False)
    d1, d2 = ordered._digits(F.col("value"), F.col("_low"), F.col("_high"))
    assert placed.select(d1, d2).distinct().count() <= 65_536
    cum = running_totals(counts, ["model"], ["n"], range_group=["model"])
    assert cum.agg(F.count_if(F.abs(F.col("cum_n") - F.exp("value")) > 0.5)).first()[0] == 0
