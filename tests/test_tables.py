"""Harmonization, quality, verdicts, alerts, sources, model loop and streaming on small tables."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltmark.config import (
    CATEGORICAL,
    CREDIT_FEATURES,
    Feature,
    Rules,
    load_features,
    load_rules,
)
from siltmark.operators import alerts, evaluation, harmonize, model, quality, reports, retrain, verdict
from siltmark.operators.validate import validate_records
from siltmark.plans.drift_run import drift_run
from siltmark.sources import files, ingest, partitions

FEATURES = (
    Feature("income", min=1000, max=1_000_000, importance="high"),
    Feature("category", CATEGORICAL, allowed_values=("A", "B", "C")),
)
RULES = Rules()
TABLE = "income double, category string"


def rows(df):
    return [r.asDict() for r in df.collect()]


def checks(spark, data, schema=TABLE, features=FEATURES, **options):
    df = spark.createDataFrame(data, schema)
    found, metrics, summary = quality.quality_report(df, features, RULES, **options)
    return {r["check"]: r for r in rows(found)}, rows(metrics), rows(summary)[0]


def test_clean_table_passes(spark):
    found, metrics, summary = checks(spark, [(5e4, "A"), (6e4, "B"), (7e4, "C")])
    assert not found and summary["passed"] and all(m["passed"] for m in metrics)


def test_null_rate(spark):
    found, _, summary = checks(spark, [(None if i < 4 else 5e4, "A") for i in range(10)])
    assert found["null_rate_exceeded"]["severity"] == "CRITICAL" and not summary["passed"]
    assert found["null_rate_exceeded"]["message"] == (
        "Feature 'income' null rate 40.0% exceeds threshold 5.0%"
    )
    found, _, summary = checks(spark, [(None if i < 1 else 5e4, "A") for i in range(10)])
    assert found["null_rate_exceeded"]["severity"] == "WARNING" and summary["passed"]


def test_nan_counts_as_missing(spark):
    found, metrics, _ = checks(spark, [(float("nan"), "A"), (5e4, "A")])
    assert metrics[0]["null_count"] == 1 and "null_rate_exceeded" in found


def test_unknown_categories(spark):
    found, _, _ = checks(spark, [(5e4, "A" if i < 5 else "UNKNOWN_CAT") for i in range(10)])
    assert found["oov_categories"]["severity"] == "WARNING"
    assert found["oov_categories"]["metric_value"] == 0.5


def test_missing_column(spark):
    found, _, summary = checks(spark, [("A",), ("B",)], "category string")
    assert found["missing_column"]["feature"] == "income" and not summary["passed"]


def test_empty_table(spark):
    found, metrics, summary = checks(spark, [])
    assert set(found) == {"empty_dataset"} and not summary["passed"] and not metrics


def test_types_and_ranges(spark):
    data = [("5000", "A"), ("abc", "A"), ("1d", "A"), (None, "A"), (" 7000 ", "A"), ("9e9", "A")]
    found, metrics, summary = checks(spark, data, "income string, category string")
    assert metrics[0]["non_numeric_count"] == 2 and not summary["passed"]
    assert found["out_of_range"]["metric_value"] == pytest.approx(1 / 3, abs=1e-4)
    assert metrics[0]["out_of_bounds_pct"] == pytest.approx(1 / 3, abs=1e-4)
    _, metrics, _ = checks(spark, data, "income string, category string", compat=True)
    assert metrics[0]["non_numeric_count"] == 1


CRM = {
    "source_name": "crm",
    "column_mapping": {
        "ma_ho_so": "record_id", "nam_sinh": "_birth_year", "luong_thang": "_monthly_income",
        "diem_fio": "credit_score", "tinh_trang_nha_o": "home_ownership",
        "muc_dich_vay": "loan_intent",
    },
    "derivations": {"age": "2026 - _birth_year", "annual_income": "_monthly_income * 12"},
    "value_mappings": {
        "home_ownership": {"Thuê trọ": "RENT", "Thế chấp ngân hàng": "MORTGAGE", 1: "RENT"},
        "loan_intent": {"Tiêu dùng": "PERSONAL"},
    },
    "defaults": {"debt_to_income_ratio": 0.25, "loan_amount": 1.0},
}


def test_harmonize(spark):
    raw = spark.createDataFrame(
        [("REC_01", 1996, 3500, "710", "Thuê trọ", "Tiêu dùng", None, "x"),
         ("REC_02", 1988, 6000, "n/a", " Thế chấp ngân hàng ", "1", 5.0, "y")],
        "ma_ho_so string, nam_sinh long, luong_thang long, diem_fio string,"
        " tinh_trang_nha_o string, muc_dich_vay string, loan_amount double, note string",
    )
    out = harmonize.harmonize(raw, CRM, CREDIT_FEATURES, "2026-10-14T00:00:00+00:00")
    first, second = out.orderBy("request_id").collect()
    assert (first["age"], first["annual_income"], first["credit_score"]) == (30.0, 42000.0, 710.0)
    assert (first["home_ownership"], first["loan_intent"]) == ("RENT", "PERSONAL")
    assert (first["request_id"], first["source_id"]) == ("REC_01", "crm")
    assert (second["home_ownership"], second["loan_intent"]) == ("MORTGAGE", "1")
    assert (second["credit_score"], second["loan_amount"], first["loan_amount"]) == (0.0, 5.0, 1.0)
    assert first["debt_to_income_ratio"] == 0.25 and first["interest_rate"] == 0.0
    assert out.columns[:3] == ["request_id", "timestamp", "source_id"]
    assert out.columns[3:12] == [f.name for f in CREDIT_FEATURES]
    assert out.columns[12:] == ["record_id", "note"]


def test_harmonize_stays_narrow(spark, small_dir):
    raw = spark.read.parquet(f"{small_dir}/orders.parquet")
    out = harmonize.harmonize(
        raw, {"column_mapping": {"o_totalprice": "amount"}, "derivations": {"half": "amount / 2.0"}},
        [Feature("amount"), Feature("half")], "t",
    )
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 2 and "Exchange" not in plan


def test_derivations(spark):
    df = spark.createDataFrame([(1, 10)], "a int, b int")
    with pytest.warns(UserWarning, match="skipped"):
        out = harmonize.derive_columns(df, {"third": "a / 3.0", "bad": "nope * 2", "a": "b + 1"})
    row = out.collect()[0]
    assert row["third"] == pytest.approx(1 / 3, abs=1e-15) and row["a"] == 11
    assert "bad" not in out.columns
    kept = harmonize.derive_columns(df, {"a": "b + 1"}, only_if_missing=True)
    assert kept.collect()[0]["a"] == 1
    assert harmonize.double_literals("x / 100.0 + '1.5'") == "x / 100.0D + '1.5'"


def test_generated_request_ids_are_unique(spark):
    out = harmonize.add_tracking(spark.range(50).toDF("x"))
    assert out.select("request_id").distinct().count() == 50
    assert out.filter("source_id = 'adapter_ingest'").count() == 50


def test_compat_coercion(spark):
    df = spark.createDataFrame([(None,)], "c string")
    feats = [Feature("c", CATEGORICAL)]
    assert harmonize.coerce_features(df, feats).collect()[0]["c"] is None
    assert harmonize.coerce_features(df, feats, compat=True).collect()[0]["c"] == "nan"


def test_validation_reasons(spark):
    good = (30.0, 1.0, 700.0, 0.1, 10.0, 5.0, "OWN", "CAR", 3.0)
    bad = (17.0, -1.0, 900.0, 9.0, 0.0, 51.0, None, "CAR", 71.0)
    df = spark.createDataFrame([good, bad], ", ".join(
        f"{f.name} {'double' if f.is_numerical else 'string'}" for f in CREDIT_FEATURES))
    valid, quarantine = validate_records(df)
    assert valid.count() == 1
    assert len(quarantine.collect()[0]["reasons"]) == 8


def test_delimited_readers(spark, tmp_path):
    for name, text in {
        "comma.csv": "a,b\n1,x\n", "semi.csv": "a;b\n1;x\n", "tab.tsv": "a\tb\n1\tx\n",
        "single.csv": "a\n1\n", "bom.csv": "﻿a,b\n1,x\n",
    }.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
        df = files.read_any(spark, str(tmp_path / name))
        assert df.columns[0] == "a" and df.collect()[0][0] == 1, name
    (tmp_path / "latin.csv").write_bytes("naïve,b\né,1\n".encode("latin-1"))
    df = files.read_any(spark, str(tmp_path / "latin.csv"))
    assert df.columns == ["naïve", "b"] and df.collect()[0][0] == "é"


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "b.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    for name in ("a.jsonl", "b.json"):
        assert sorted(r["a"] for r in files.read_any(spark, str(tmp_path / name)).collect()) == [1, 2]
    assert files.read_parquet(spark, str(tmp_path / "a.parquet")).count() == 2
    with pytest.raises(files.UnsupportedFormat):
        files.read_any(spark, "x.docx")


def test_incremental_files(spark, tmp_path):
    pattern = str(tmp_path / "in" / "*.csv")
    (tmp_path / "in").mkdir()
    for i, text in enumerate(["x\n1\n2\n", "x\n3\n4\n"]):
        (tmp_path / "in" / f"batch_{i}.csv").write_text(text)
    got, ledger = ingest.ingest_new_files(spark, pattern)
    assert got.count() == 4 and ledger.count() == 2
    assert {r["row_count"] for r in ledger.collect()} == {2}
    got, ledger = ingest.ingest_new_files(spark, pattern, ledger)
    assert got is None and ledger.count() == 2
    (tmp_path / "in" / "batch_2.csv").write_text("x\n5\n6\n")
    (tmp_path / "in" / "empty.csv").write_text("")
    got, ledger = ingest.ingest_new_files(spark, pattern, ledger)
    assert sorted(r["x"] for r in got.collect()) == [5, 6] and ledger.count() == 3
    (tmp_path / "in" / "batch_2.csv").write_text("x\n7\n")
    got, ledger = ingest.ingest_new_files(spark, pattern, ledger)
    assert [r["x"] for r in got.collect()] == [7] and ledger.count() == 3


def test_window_query_is_half_open(spark):
    spark.createDataFrame(
        [("A01", "2026-10-14 00:00:00"), ("A02", "2026-10-14 04:00:00"),
         ("A03", "2026-10-14 06:00:00"), ("A04", "2026-10-13 10:00:00")],
        "app_id string, created_at string",
    ).createOrReplaceTempView("window_applications")
    sql = ("SELECT app_id FROM window_applications"
           " WHERE created_at >= :window_start AND created_at < :window_end")
    got = ingest.read_window_query(spark, sql, "2026-10-14 00:00:00", "2026-10-14 06:00:00")
    assert {r["app_id"] for r in got.collect()} == {"A01", "A02"}
    got = ingest.read_window_query(spark, sql, end=datetime(2026, 10, 14, 6))
    assert got.count() == 2


def test_partition_scan(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = spark.createDataFrame(
        [(1, "2026-09-24T09:59:59+00:00"), (2, "2026-09-24T10:00:00+00:00"),
         (3, "2026-09-24T12:00:00+00:00"), (4, "not a time"), (5, "2026-09-24T12:00:01+00:00")],
        "id int, timestamp string",
    )
    partitions.write_partitioned(logs, path, batch_time="2026-09-24 10:30:00")
    late = tmp_path / "logs/year=2026/month=09/day=24/hour=11"
    late.mkdir(parents=True)
    (late / "x.jsonl").write_text('{"id": 6, "timestamp": "2026-09-24T11:00:00+00:00"}\n')
    window = ("2026-09-24 10:00:00", "2026-09-24 12:00:00")
    got = partitions.scan_window(spark, path, *window)
    assert {r["id"] for r in got.collect()} == {2, 3, 6}
    half = partitions.scan_window(spark, path, *window, inclusive_end=False, columns=["id", "nope"])
    assert {r["id"] for r in half.collect()} == {2, 6} and half.columns == ["id"]
    assert partitions.scan_window(spark, path, "2026-09-24 13:00:00", "2026-09-24 14:00:00").count() == 0
    assert partitions.scan_window(spark, str(tmp_path / "none"), *window).count() == 0
    assert partitions.unparsable_timestamps(logs).collect()[0]["unparsable"] == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_ingest_scores_and_saves(spark, tmp_path):
    raw = spark.createDataFrame(
        [(f"ID_{i}", 1990, 5000, 600 + 10 * i) for i in range(10)],
        "ma_ho_so string, nam_sinh long, luong_thang long, diem_fio long",
    )
    feats = [f for f in CREDIT_FEATURES if f.name in ("age", "annual_income", "credit_score")]
    train = harmonize.harmonize(raw, CRM, feats, "t").withColumn(
        "label", (F.col("credit_score") < 650).cast("int"))
    fitted = model.train_challenger(train, feats, iterations=2, depth=2)
    out = str(tmp_path / "logs")
    result = ingest.ingest(spark, raw, CRM, feats, out, fitted, "v1", batch_time="2026-01-02 03:00:00")
    assert (result.status, result.record_count, len(result.sample)) == ("SUCCESS", 10, 3)
    back = spark.read.parquet(f"{out}/year=2026/month=01/day=02/hour=03")
    assert back.count() == 10
    assert {"prediction_score", "prediction_label", "model_version", "age"} <= set(back.columns)
    assert back.filter("prediction_score NOT BETWEEN 0 AND 1").count() == 0
    none = ingest.ingest(spark, raw.limit(0), CRM, feats, out)
    assert none.status == "NO_NEW_DATA"


def test_config_files(tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"features": [
        {"name": "a", "type": "categorical", "importance": "low", "allowed_values": ["x"], "extra": 1}]}))
    assert load_features(str(tmp_path / "f.json")) == (
        Feature("a", CATEGORICAL, "low", allowed_values=("x",)),)
    (tmp_path / "r.json").write_text(json.dumps({
        "metrics": {"psi": {"moderate_drift": 0.3}}, "quality": {"max_null_pct": 0.5}}))
    rules = load_rules(str(tmp_path / "r.json"))
    assert (rules.psi_drift, rules.max_null_pct, rules.psi_warning) == (0.3, 0.5, 0.1)


def run_status(spark, severe, warn, pred, passed, qwarn):
    df = spark.createDataFrame(
        [(severe, warn, pred, passed, qwarn)], "s int, w int, p string, ok boolean, q int")
    c = verdict.overall_status(*[F.col(x) for x in ("s", "w", "p", "ok", "q")])
    return df.select(c.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("case, want", [
    ((2, 0, None, True, 0), "DRIFT_DETECTED"), ((0, 0, "DRIFT", True, 0), "DRIFT_DETECTED"),
    ((0, 0, None, False, 0), "DRIFT_DETECTED"), ((1, 0, "STABLE", True, 0), "WARNING"),
    ((0, 1, None, True, 0), "WARNING"), ((0, 0, "WARNING", True, 1), "WARNING"),
    ((0, 0, "WARNING", True, 0), "STABLE"),
])
def test_overall_status(spark, case, want):
    assert run_status(spark, *case) == want


def test_single_run(spark):
    ref = spark.createDataFrame([(5e4 + i, "ABC"[i % 3], i / 300) for i in range(300)],
                                TABLE + ", prediction_score double")
    run = drift_run(ref, ref, FEATURES)
    row = rows(run.runs)[0]
    assert (row["overall_status"], row["sample_count"], row["max_psi"]) == ("STABLE", 300, 0)
    few = drift_run(ref.limit(50), ref, FEATURES)
    row = rows(few.runs)[0]
    assert row["overall_status"] == "INSUFFICIENT_DATA" and few.metrics.count() == 0
    assert row["summary"].startswith("Batch contained 50 samples (minimum required: 100)")
    moved = ref.selectExpr("income * 10 AS income", "'Z' AS category", "prediction_score")
    run = drift_run(moved, ref, FEATURES)
    row = rows(run.runs)[0]
    assert row["overall_status"] == "DRIFT_DETECTED" and row["severe_drift_count"] == 2


def candidate_frame(spark, items):
    return spark.createDataFrame(
        [(k, datetime.fromisoformat(t), h, i) for i, (k, t, h) in enumerate(items)],
        "dedup_key string, candidate_at timestamp, cooldown_hours int, position int")


def test_cooldown_boundaries(spark):
    got = alerts.cooldown_replay(candidate_frame(spark, [
        ("a", "2026-01-01 00:00:00", 12), ("a", "2026-01-01 11:59:59", 12),
        ("a", "2026-01-01 12:00:00", 12), ("a", "2026-01-01 18:00:00", 12),
        ("b", "2026-01-01 01:00:00", 6), ("a", "2026-01-02 00:00:00", 12),
    ])).orderBy("dedup_key", "candidate_at")
    assert [r["delivered"] for r in got.collect()] == [True, False, True, False, True, True]


def test_suppression(spark):
    cands = candidate_frame(spark, [
        ("a", "2026-01-01 00:00:00", 12), ("b", "2026-01-01 00:00:00", 12),
        ("b", "2026-01-01 00:00:00", 12), ("c", "2026-01-01 00:00:00", 6),
    ]).withColumns({c: F.lit("x") for c in ("feature_name", "alert_type", "message")})
    sent = spark.createDataFrame(
        [("a", datetime(2026, 1, 1, 6)), ("c", datetime(2026, 1, 1, 0))],
        "dedup_key string, cooldown_until timestamp")
    out = alerts.suppress_and_record(cands, sent, "2026-01-01 00:00:00")
    got = {r["dedup_key"]: r for r in out.collect()}
    assert set(got) == {"b", "c"} and got["b"]["position"] == 1
    assert got["c"]["cooldown_until"] == datetime(2026, 1, 1, 6)


def test_jobs(spark):
    schema = ("id long, run_id long, triggered_by string, status string, champion_version string,"
              " challenger_version string, metrics string, approved_by string, error_message string,"
              " created_at timestamp, updated_at timestamp")
    at = datetime(2026, 1, 1)
    none = (None,) * 5
    jobs = spark.createDataFrame([(1, 7, "A", "RUNNING", *none, at, at)], schema)
    out = retrain.close_pending_job(jobs, {"verdict": "REJECTED", "delta_auc": -0.1}, "2026-01-02")
    new = {r["id"]: r for r in out.collect()}
    assert set(new) == {1, 2} and new[2]["status"] == "REJECTED" and new[1]["status"] == "RUNNING"
    assert json.loads(new[2]["metrics"]) == {"delta_auc": -0.1}
    assert reports.active_champion(jobs).count() == 0
    assert reports.sort_page(jobs.select(F.lit(0.1).alias("psi")).limit(0)).count() == 0


def test_binary_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [("m", 0, 0.1), ("m", 0, 0.4), ("m", 1, 0.35), ("m", 1, 0.8), ("one", 1, 0.9), ("one", 1, 0.2)],
        "model string, label int, score double")
    got = {r["model"]: r for r in evaluation.binary_metrics(df).collect()}
    assert (got["m"]["roc_auc"], got["m"]["pr_auc"]) == (0.75, 0.8333)
    assert got["m"]["f1_score"] == 0.6667
    assert (got["one"]["roc_auc"], got["one"]["pr_auc"]) == (0.5, 1.0)


@pytest.mark.parametrize("auc, want", [(0.47, "APPROVED"), (0.469, "REJECTED"), (0.9, "APPROVED")])
def test_gate(spark, auc, want):
    schema = "model string, roc_auc double, pr_auc double, f1_score double, log_loss double"
    both = spark.createDataFrame([("champion", 0.5, 0.5, 0.5, 0.5), ("challenger", auc, 0.5, 0.5, 0.5)], schema)
    assert evaluation.champion_challenger(both).collect()[0]["verdict"] == want
    alone = evaluation.champion_challenger(both.filter("model = 'challenger'")).collect()[0]
    assert alone["verdict"] == "APPROVED" and alone["champion_roc_auc"] == 0.5


def test_registry(spark):
    empty = spark.createDataFrame([], model.REGISTRY_SCHEMA)
    assert model.next_version(empty).collect()[0][0] == "v1"
    verdict_ = spark.createDataFrame([("v1", "REJECTED")], "candidate_version string, verdict string")
    assert model.promote(empty, verdict_, "2026-01-01").count() == 0
    first = model.promote(empty, verdict_, "2026-01-01", force=True)
    assert model.rollback(first, "2026-01-01").count() == 0
    ok = spark.createDataFrame([("v2", "APPROVED")], "candidate_version string, verdict string")
    second = first.unionByName(model.promote(first, ok, "2026-01-02"))
    back = model.rollback(second, "2026-01-03").collect()[0]
    assert (back["seq"], back["version"], back["previous_version"]) == (3, "v1", "v2")
    assert model.next_version(second).collect()[0][0] == "v3"


def test_split_shares(spark):
    df = spark.createDataFrame([(i, int(i < 100)) for i in range(1000)], "id int, label int")
    split = model.stratified_split(df, "label", ["id"])
    got = {r["label"]: r["n"] for r in split.filter("is_validation").groupBy("label").agg(
        F.count("*").alias("n")).collect()}
    assert got == {0: 225, 1: 25} and split.count() == 1000


def test_training_set_needs_enough_recent_rows(spark):
    feats = [Feature("x")]
    base = spark.createDataFrame([(1.0, 1)], "x double, target int")
    few = spark.createDataFrame([(2.0, 0.9)] * 99, "x double, prediction_score double")
    many = spark.createDataFrame([(2.0, 0.9)] * 100, "x double, prediction_score double")
    assert model.training_set(base, few, feats).count() == 1
    got = model.training_set(base, many, feats)
    assert got.count() == 101 and got.filter("label = 1").count() == 101


def test_score_defaults(spark):
    df = spark.createDataFrame([(500.0,), (700.0,)], "credit_score double")
    got = [r[0] for r in df.select(model.heuristic_score(df)).collect()]
    assert got == pytest.approx([0.55, 0.2])
    bare = spark.range(1)
    assert bare.select(model.heuristic_score(bare)).collect()[0][0] == pytest.approx(0.35)


def test_episodes_measure_the_delay(spark):
    start = datetime(2026, 1, 1)
    at = lambda k: start + timedelta(hours=6 * k)
    psi = [0.0, 0.1, 0.3, 0.5, 0.0, 0.1, 0.1, 0.0, 0.9, 0.9]
    drifted = [False, True, True, True, False, True, True, False, True, True]
    kept = [k for k in range(10) if k != 9]  # the last window has no run: windows 8 and 10 are apart
    rows = [(at(k), psi[k]) for k in kept] + [(at(10), None)]
    series = spark.createDataFrame(rows, "window_start timestamp, psi double")
    labels = spark.createDataFrame([(at(k), drifted[k]) for k in kept] + [(at(10), True)], "window_start timestamp, drifted boolean")
    out = [(r.onset, r.windows, r.first_hit, r.delay_hours) for r in evaluation.drift_episodes(series, labels).orderBy("episode").collect()]
    assert out == [(at(1), 3, at(2), 12.0), (at(5), 2, None, None), (at(8), 1, at(8), 6.0), (at(10), 1, None, None)]
    got = evaluation.detector_backtest(series, labels).first()
    assert (got.episodes, got.detected_episodes, got.detection_delay_hours) == (4, 2, 9.0)
    none = evaluation.detector_backtest(series, labels.withColumn("drifted", F.lit(False))).first()
    assert none.episodes == 0 and none.detection_delay_hours is None


def walked(rows):
    """The replay as a walk, row by row: the rule itself."""
    until, out = {}, []
    for key, at, hours in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        send = key not in until or until[key] <= at
        if send:
            until[key] = at + timedelta(hours=hours)
        out.append((key, at, hours, send))
    return out


def test_cooldown_replay_equals_a_walk(spark):
    """One key with most rows, many moments twice, cooldowns of zero, a NULL key."""
    draw = random.Random(5)
    begin = datetime(2026, 1, 1)
    keys = ["hot"] * 30 + ["a", "b", None]
    rows = [(draw.choice(keys), begin + timedelta(minutes=draw.randrange(4000)), draw.choice([0, 1, 1, 2, 7])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "dedup_key string, candidate_at timestamp, cooldown_hours int").repartition(7)
    got = [tuple(r) for r in alerts.cooldown_replay(frame).collect()]
    assert sorted(got, key=str) == sorted(walked(rows), key=str)


def test_cooldown_replay_odd_rows(spark):
    at = datetime(2026, 1, 1)
    schema = "dedup_key string, candidate_at timestamp, cooldown_hours int, delivered string"
    rows = [("a", None, 3, "x"), ("a", at, None, "x"), ("a", at, 5, "x"), ("a", at, 5, "x"), ("b", at, -1, "x"), ("b", at, -1, "x")]
    got = alerts.cooldown_replay(spark.createDataFrame(rows, schema)).groupBy("dedup_key").agg(
        F.count("*").alias("n"), F.count_if("delivered").alias("sent")).collect()
    assert {r["dedup_key"]: (r["n"], r["sent"]) for r in got} == {"a": (4, 2), "b": (2, 2)}
    assert alerts.cooldown_replay(spark.createDataFrame([], schema)).count() == 0


def test_quality_missing_equals_its_sql_on_bad_values(spark, tmp_path):
    """Values out of range, missing values and types have their own queries: they add nothing to this one."""
    from siltmark.plans.catalog import ORACLES, QUERIES
    from tests.compare import difference, duckdb

    rows = [(i, datetime(2024, 1, 9), i, None if i % 5 == 0 else "odd" if i % 7 == 0 else "view", None if i % 3 == 0 else 1000.0, '{"k": 1}') for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert difference(QUERIES["quality_missing"](spark, str(tmp_path)), con, ORACLES["quality_missing"]) is None
