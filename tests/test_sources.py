"""Readers, ingestion, log tables and model inputs on hostile data."""

from __future__ import annotations

import warnings
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltmark.config import CATEGORICAL, Feature
from siltmark.operators import model
from siltmark.operators.longform import with_window
from siltmark.sources import artifacts, files, ingest, partitions, zones
from siltmark.sources.manifest import Manifest
from siltmark.sources.runs import RunStore
from siltmark.sources.workspace import stored
from siltmark.streaming import jobs

FEATURES = [Feature("annual_income"), Feature("credit_score"), Feature("kind", CATEGORICAL)]


def test_encoding_is_decided_on_the_whole_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,note\n1,plain\n2,caf\xe9\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("id,note\n1,caf\xe9 �\n".encode())
    assert [r.note for r in files.read_delimited(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == ["plain", "café"]
    assert files.read_delimited(spark, str(tmp_path / "b.csv")).first().note == "café �"


def test_separator_is_what_parses_to_columns(spark, tmp_path):
    assert files.separator_of('"a,b";c') == ";" and files.separator_of("only") == "," and files.separator_of("a\tb") == "\t"
    (tmp_path / "a.csv").write_text('"a,b";c\n1;2\n')
    assert files.read_delimited(spark, str(tmp_path / "a.csv")).columns == ["a,b", "c"]


def test_malformed_json_fails_and_documents_are_read(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.read_json_any(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "whole.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in files.read_json_any(spark, str(tmp_path / "whole.json")).collect()) == [1, 2]


def test_ingestion_neither_loses_nor_repeats(spark, tmp_path):
    folder = tmp_path / "in coming"
    folder.mkdir()
    (folder / "a.csv").write_text("id,v\n1,x\n2,y\n")
    (folder / "b.csv").write_bytes(b"id,v\n3,caf\xe9\n")
    (folder / "c.csv").write_text("")
    (folder / "d.jsonl").write_text('{"id": 4}\n{"id"')
    (folder / "e.parquet").write_bytes(b"PAR1 is not enough")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows, ledger = ingest.ingest_new_files(spark, f"{folder}/*")
        assert sorted((r.id, r.v) for r in rows.collect()) == [(1, "x"), (2, "y"), (3, "café")]
        assert sorted(r.path.rsplit("/", 1)[1] for r in ledger.collect()) == ["a.csv", "b.csv"]
        assert ingest.ingest_new_files(spark, f"{folder}/*", ledger)[0] is None
        (folder / "a.csv").write_text("id,v\n9,z\n")
        rows, ledger = ingest.ingest_new_files(spark, f"{folder}/*", ledger)
    assert [(r.id, r.v) for r in rows.collect()] == [(9, "z")] and ledger.count() == 2


def test_unreadable_times_are_counted_and_never_fail(spark, tmp_path):
    texts = ["2024-01-05 10:30:00", "2024-01-05T11:15:00+01:00", "2024-01-05", "not a time", None]
    logs = spark.createDataFrame(list(enumerate(texts)), "id int, timestamp string")
    path = partitions.write_partitioned(logs, str(tmp_path / "logs"), time_col="timestamp")
    out = partitions.scan_window(spark, path, "2024-01-05 10:00:00", "2024-01-05 10:59:59", columns=["id"])
    assert sorted(r.id for r in out.collect()) == [0, 1]
    assert all("hour=10" in f for f in out.inputFiles())
    assert partitions.unparsable_timestamps(logs).first().unparsable == 1
    starts = {r.id: r.window_start for r in with_window(logs, size="6 hours").collect()}
    assert starts == {0: datetime(2024, 1, 5, 6), 1: datetime(2024, 1, 5, 6), 2: datetime(2024, 1, 5)}
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        path = partitions.write_partitioned(logs, str(tmp_path / "other"), time_col="timestamp")
        out = partitions.scan_window(spark, path, "2024-01-05 10:00:00", "2024-01-05 10:59:59", columns=["id"])
        assert sorted(r.id for r in out.collect()) == [0, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_scan_of_a_window_without_folders_is_empty(spark, tmp_path):
    logs = spark.createDataFrame([(1, "2024-01-05 10:30:00")], "id int, timestamp string")
    path = partitions.write_partitioned(logs, str(tmp_path / "logs"), time_col="timestamp")
    assert partitions.scan_window(spark, path, "2023-01-01 00:00:00", "2023-01-02 00:00:00", columns=["id"]).collect() == []


def test_missing_cells_in_training_and_scoring(spark):
    nan = float("nan")
    rows = [(float(k * 100), 500.0 + k, "ab"[k % 2], k % 2) for k in range(60)] + [(nan, None, None, 1), (None, nan, "c", 0)]
    df = spark.createDataFrame(rows, "annual_income double, credit_score double, kind string, label int")
    empty = Feature("gone")
    df = df.withColumn("gone", F.lit(None).cast("string"))
    fitted = model.train_challenger(df, [*FEATURES, empty], iterations=2, depth=2)
    once = model.score_batch(df, fitted, "v1")
    twice = model.score_batch(once, fitted, "v2")
    assert once.count() == twice.count() == 62 and set(once.columns) == set(twice.columns)
    assert twice.filter("prediction_score IS NULL OR model_version <> 'v2'").count() == 0


def test_training_rows_of_one_task_are_shared_by_all(spark, monkeypatch):
    """Every pass over the training rows reads the stored files, not what they were made from; rows keep their order."""
    monkeypatch.setattr(model, "PASS_ROWS", 10)
    seen = []
    monkeypatch.setattr(model, "stored", lambda *args: seen.append(stored(*args)) or seen[-1])
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = spark.range(60, numPartitions=1).selectExpr("100.0D * id AS annual_income", "500.0D + id AS credit_score", "CASE id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS kind", "int(id % 2) AS label", "NULL AS gone")
    once = df.drop("gone").mapInPandas(counted, df.drop("gone").schema).withColumn("gone", F.lit(None))
    fitted = model.train_challenger(once, (f for f in [*FEATURES, Feature("gone")]), iterations=3, depth=2)
    assert made.value == 60 and len(seen) == 1
    files = seen[0].groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min("credit_score").alias("a"), F.max("credit_score").alias("b")).collect()
    assert sorted((r.n, r.b - r.a) for r in files) == [(10, 9.0)] * 6
    assert model.score_batch(df, fitted, "v1").filter("prediction_score IS NULL").count() == 0


def test_unknown_scores_and_incomes(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.7,)], "prediction_score double")
    assert [r[0] for r in df.select(model.training_label(df)).collect()] == [0, 0, 1]
    assert [r.prediction_label for r in model.with_label(df).collect()] == [None, None, 1]
    people = spark.createDataFrame([(None,), (500.0,)], "annual_income double")
    assert [r[0] for r in people.select(model.heuristic_score(people)).collect()][0] == pytest.approx(0.35)


def test_training_takes_the_last_days(spark):
    base = spark.createDataFrame([(1.0, 0)], "x double, target int")
    logs = spark.range(300).selectExpr(
        "CAST(id AS DOUBLE) AS x", "1 AS prediction_label", "timestamp'2024-03-01 00:00:00' - make_dt_interval(0, CAST(id AS INT)) AS timestamp"
    )
    out = model.training_set(base, logs, [Feature("x")], now="2024-03-01 00:00:00")
    assert out.count() == 1 + 7 * 24 + 1


STATE = "cell string, count long"


def fill(spark, path, batches):
    for number, rows in batches:
        jobs.update_sink(path)(spark.createDataFrame(rows, STATE), number)


def state(spark, path):
    return sorted((tuple(r) for r in jobs.read_latest(spark, path, ["cell"]).collect()), key=str)


def test_compacted_sink_keeps_the_last_value_per_key(spark, tmp_path):
    path = str(tmp_path / "sink")
    batches = list(enumerate(([("a", 1), ("b", 1)], [("a", 2), (None, 3)], [("c", 5), ("b", 7)])))
    fill(spark, path, batches)
    want = [("a", 2), ("b", 7), ("c", 5), (None, 3)]
    assert state(spark, path) == want
    jobs.compact(spark, path, ["cell"])
    assert state(spark, path) == want and len(Manifest(spark, path).latest()[1]) == 1
    fill(spark, path, batches)  # a replay of any batch changes nothing
    assert state(spark, path) == want and len(Manifest(spark, path).latest()[1]) == 1
    fill(spark, path, [(3, [("a", 9)])])
    jobs.compact(spark, path, ["cell"])
    assert state(spark, path) == [("a", 9), *want[1:]]


def test_sink_survives_a_break_between_any_two_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "sink")
    fill(spark, path, [(0, [("a", 1)]), (1, [("a", 2), ("b", 1)])])

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Manifest, "publish", broken)  # rows staged, list not published
        for step in (lambda: fill(spark, path, [(2, [("b", 5)])]), lambda: jobs.compact(spark, path, ["cell"])):
            with pytest.raises(RuntimeError):
                step()
    assert state(spark, path) == [("a", 2), ("b", 1)]
    with monkeypatch.context() as m:
        m.setattr(Manifest, "stage", broken)
        with pytest.raises(RuntimeError):
            jobs.compact(spark, path, ["cell"])
    fill(spark, path, [(2, [("b", 5)])])
    jobs.compact(spark, path, ["cell"])
    assert state(spark, path) == [("a", 2), ("b", 5)]
    assert len(Manifest(spark, path).vacuum(hours=0)) == 5 and state(spark, path) == [("a", 2), ("b", 5)]


def test_writers_of_one_version_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "sink")
    fill(spark, path, [(0, [("a", 1)]), (1, [("b", 1)])])
    manifest, late = Manifest(spark, path), []

    def change(now):
        if not late:  # the stream commits while this writer thinks
            late.append(1)
            fill(spark, path, [(2, [("c", 1)])])
        return [*now, {"folder": now[0]["folder"], "first": 7, "last": 7}]

    manifest.publish(change)
    assert [e["first"] for e in manifest.latest()[1]] == [0, 1, 2, 7]


def test_stream_takes_every_content_once(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    mapping = {"source_id": "s", "column_mapping": {"id": "request_id", "v": "annual_income"}}

    def drain():
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            jobs.stream_ingest_contents(
                spark, f"{folder}/*", mapping, [Feature("annual_income")], out, str(tmp_path / "checkpoint"), "availableNow", "2024-01-01"
            ).awaitTermination()
        return sorted(r[0] for r in jobs.read_ingested(spark, out).select("annual_income").collect())

    (folder / "a.csv").write_text("id,v\n1,10\n2,20\n")
    (folder / "twin.csv").write_text("id,v\n1,10\n2,20\n")
    (folder / "bad.jsonl").write_text('{"id": 4}\n{"id"')
    assert drain() == [10, 20]
    (folder / "a.csv").write_text("id,v\n3,30\n")  # changed under its name
    (folder / "twin.csv").rename(folder / "renamed.csv")
    assert drain() == [10, 20, 30]
    (folder / "b.csv").write_text("id,v\n3,30\n")  # a known content
    assert drain() == [10, 20, 30]
    (folder / "bad.jsonl").write_text('{"id": 4, "v": 40}')
    assert drain() == [10, 20, 30, 40]
    numbers = [n for e in Manifest(spark, out).latest()[1] for n in range(e["first"], e["last"] + 1)]
    assert numbers == sorted(set(numbers))  # every batch once


def test_late_rows_are_found_and_only_overlapping_files_opened(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [(1, "2024-01-05 10:30:00"), (2, "2024-01-05 14:00:00"), (3, "not a time"), (4, None)]
    logs = spark.createDataFrame(rows, "id int, timestamp string")
    partitions.write_partitioned(logs.coalesce(1), path, "2024-01-05 14:10:00")
    late = spark.createDataFrame([(5, "2024-01-05 10:59:59")], "id int, timestamp string")
    partitions.write_partitioned(late.coalesce(1), path, "2024-01-09 03:00:00")
    window = ("2024-01-05 10:00:00", "2024-01-05 10:59:59")
    assert [r.id for r in partitions.scan_window(spark, path, *window, columns=["id"]).collect()] == []
    out = zones.scan_events(spark, path, *window, columns=["id"])
    assert sorted(r.id for r in out.collect()) == [1, 5]
    later = zones.scan_events(spark, path, "2024-01-05 12:00:00", "2024-01-06 00:00:00", columns=["id"])
    assert [r.id for r in later.collect()] == [2] and len(later.inputFiles()) == 1
    assert zones.update_zone_map(spark, path) == 0 and zones.zone_map(spark, path).count() == 2
    zones.fold_zone_map(spark, path)
    assert zones.zone_map(spark, path).count() == 2
    assert zones.scan_events(spark, path, "2020-01-01 00:00:00", "2020-01-02 00:00:00", columns=["id"]).collect() == []


def test_a_repeated_run_replaces_and_a_broken_one_is_not_seen(spark, tmp_path, monkeypatch):
    store = RunStore(spark, str(tmp_path / "runs"))

    def save(rows, cells):
        tables = {"runs": spark.createDataFrame(rows, "run_id long, status string"), "metrics": spark.createDataFrame(cells, "run_id long, psi double")}
        store.commit({name: store.stage(df, name)[0] for name, df in tables.items()})

    def seen():
        return [sorted(tuple(r) for r in store.read(n).collect()) for n in ("runs", "metrics")]

    save([(1, "STABLE"), (2, "DRIFT")], [(1, 0.1), (2, 0.3), (2, 0.4)])
    before = seen()
    save([(1, "STABLE"), (2, "DRIFT")], [(1, 0.1), (2, 0.3), (2, 0.4)])
    assert seen() == before
    save([(2, "WARNING")], [(2, 0.2)])
    after = [[(1, "STABLE"), (2, "WARNING")], [(1, 0.1), (2, 0.2)]]
    assert seen() == after
    with monkeypatch.context() as m:
        m.setattr(RunStore, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            save([(1, "DRIFT")], [(1, 9.0)])
    assert seen() == after
    store.fold()
    assert seen() == after and len(store.manifest.latest()[1]) == 1


def test_baseline_versions(spark, tmp_path):
    path = str(tmp_path / "baseline")
    bins = spark.createDataFrame([("x", 1.0)], "feature string, mean double")
    sample = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    artifacts.save_baseline(bins, sample, path, "v1", "loans")
    artifacts.save_baseline(bins, sample.limit(1), path, "v2")
    artifacts.save_baseline(bins.withColumn("mean", F.lit(7.0)), sample, path, "v1", "loans again")
    found = {r.baseline_id: r for r in artifacts.baseline_versions(spark, path).collect()}
    assert (found["v1"].dataset, found["v1"].sample_rows, found["v2"].sample_rows) == ("loans again", 2, 1)
    assert artifacts.load_baseline(spark, path)[0].first().mean == 7.0
    assert artifacts.load_baseline(spark, path, "v2")[1].count() == 1
    with pytest.raises(FileNotFoundError):
        artifacts.load_baseline(spark, path, "v9")


def test_parameters_are_bound_outside_literals_and_comments():
    sql = """SELECT ':window_start', "a:window_end", `:window_start`, x::date, ':it''s :window_end' -- :window_start
/* :window_end */ FROM t WHERE at >= :window_start AND at < :window_end AND y = :other AND z = :window_start_2"""
    got = ingest.bind_literals(sql, {"window_start": "2026-01-01", "window_end": "o'clock"})
    assert got == sql.replace("at >= :window_start ", "at >= '2026-01-01' ").replace("at < :window_end ", "at < 'o''clock' ")


@pytest.mark.parametrize("slices", [1, 2, 7])
def test_a_window_in_slices_gives_every_row_once(spark, slices):
    spark.range(0, 400).selectExpr("id", "TIMESTAMP '2026-10-14 00:00:00' + make_interval(0, 0, 0, 0, 0, id, 0) AS at").createOrReplaceTempView("ticks")
    sql = "SELECT id FROM ticks WHERE at >= CAST(:window_start AS TIMESTAMP) AND at < CAST(:window_end AS TIMESTAMP)"
    got = ingest.read_window_query(spark, sql, "2026-10-14 00:10:00", "2026-10-14 06:00:00", slices=slices)
    assert sorted(r.id for r in got.collect()) == list(range(10, 360))


def test_repeated_and_renamed_files_have_the_same_bytes(spark, tmp_path, monkeypatch):
    """Three files, one of them twice, one renamed between two runs; rows written anew have other bytes on another executor."""
    import hashlib

    from siltmark.plans import queries_stream

    base, seen, drain = tmp_path / "base", [], jobs.stream_ingest_contents

    def watched(*args, **options):
        seen.append({str(p.relative_to(base)): hashlib.md5(p.read_bytes()).hexdigest() for p in base.glob("in/*/*.parquet")})
        return drain(*args, **options)

    monkeypatch.setattr(queries_stream, "workspace", lambda spark, label: str(base))
    monkeypatch.setattr(queries_stream.jobs, "stream_ingest_contents", watched)
    rows = [(i, i % 9, "O", i + 0.25, datetime(2024, 1, 1), "1-URGENT") for i in range(60)]
    spark.createDataFrame(
        rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    got = queries_stream.stream_ingest_contents(spark, str(tmp_path))
    assert sorted(int(r["request_id"]) for r in got.collect()) == list(range(60))
    first, second = seen
    assert len(first) == len(second) == 4 and len(set(first.values())) == 3
    assert sorted(first.values()) == sorted(second.values()) and len(first.keys() - second.keys()) == 1


def test_streamed_edges_are_ranked_once(spark, small_dir, monkeypatch):
    from siltmark.plans import queries_stream

    seen, start = [], jobs.stream_window_counts

    def watched(logs, features, edges, *args, **options):
        seen.append(edges._jdf.queryExecution().analyzed().toString())
        return start(logs, features, edges, *args, **options)

    monkeypatch.setattr(queries_stream.jobs, "stream_window_counts", watched)
    assert queries_stream.window_counts(spark, small_dir)[0].count() > 0
    assert len(seen) == 1 and "Aggregate" not in seen[0] and "Relation" in seen[0]
