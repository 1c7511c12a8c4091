"""Registered queries: harmonization, validation, readers, partitions, ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.config import CATEGORICAL, Feature
from siltmark.functions.columns import rounded
from siltmark.operators import harmonize as H
from siltmark.operators import validate as V
from siltmark.operators.longform import to_long_numerical
from siltmark.plans import twins as S
from siltmark.plans.datasets import EVENTS, EVENTS_SQL, LINEITEM, LINEITEM_NUM, events
from siltmark.plans.registry import query, table
from siltmark.sources import files, ingest, partitions
from siltmark.sources.workspace import workspace

ORDER_MAPPING = {
    "source_name": "orders_export",
    "column_mapping": {
        "o_orderkey": "record_id", "o_totalprice": "_price", "o_orderstatus": "state",
        "o_orderpriority": "urgency", "no_such_column": "ignored",
    },
    "derivations": {
        "amount": "_price / 100.0",
        "month": "month(o_orderdate)",
        "scaled": "o_custkey / 8.0",
        "broken": "no_such_column + 1",
    },
    "value_mappings": {
        "urgency": {"1-URGENT": "URGENT", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM", 5: "NEVER"},
        "month": {12: "13"},
    },
    "defaults": {"region": "EU", "state": "X"},
}
ORDER_FEATURES = (
    Feature("amount"), Feature("scaled"), Feature("month"),
    Feature("urgency", CATEGORICAL), Feature("state", CATEGORICAL),
    Feature("channel", CATEGORICAL), Feature("discount"),
)
NOW = "2024-02-01T00:00:00+00:00"

HARMONIZED = f"""
h AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, '{NOW}' AS "timestamp",
  'orders_export' AS source_id, o_totalprice / 100.0 AS amount, o_custkey / 8.0::DOUBLE AS scaled,
  CASE WHEN month(o_orderdate) = 12 THEN 13.0 ELSE month(o_orderdate) END::DOUBLE AS month,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH'
    WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE o_orderpriority END AS urgency,
  o_orderstatus AS state, 'UNKNOWN' AS channel, 0.0::DOUBLE AS discount,
  o_orderkey AS record_id, o_custkey, o_orderdate, 'EU' AS region FROM orders)"""


def harmonized(spark, sf_dir):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the broken derivation is part of the case
        return H.harmonize(table(spark, sf_dir, "orders"), ORDER_MAPPING, ORDER_FEATURES, NOW)


def _round6(df, *names):
    return df.withColumns({n: rounded(F.col(n), 6) for n in names})


@query("harmonize_orders", f"""
WITH {HARMONIZED} SELECT * REPLACE (round(amount, 6) + 0.0 AS amount, round(scaled, 6) + 0.0 AS scaled)
FROM h""")
def harmonize_orders(spark, sf_dir):
    return _round6(harmonized(spark, sf_dir), "amount", "scaled")


@query("map_values_orders", """
SELECT o_orderkey, CASE trim(' ' || o_orderpriority || ' ') WHEN '1-URGENT' THEN 'URGENT'
    WHEN '5-LOW' THEN 'LOW' ELSE ' ' || o_orderpriority || ' ' END AS padded,
  CASE WHEN o_custkey = 1 THEN 'one' WHEN o_custkey = 2 THEN 'two' ELSE CAST(o_custkey AS VARCHAR) END
    AS o_custkey, o_orderstatus FROM orders""")
def map_values_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("padded"),
        "o_custkey", "o_orderstatus",
    )
    return H.map_values(o, {
        "padded": {"1-URGENT": "URGENT", "5-LOW": "LOW"},
        "o_custkey": {1: "one", "2": "two"}, "o_orderstatus": {1: "not a text key"},
    })


@query("derive_columns_orders", """
SELECT o_orderkey, round(o_totalprice * 12, 4) + 0.0 AS yearly, round(o_custkey / 3.0::DOUBLE, 6) AS third,
       round(850 - (o_custkey / 3.0::DOUBLE) * 12.5, 6) AS nested FROM orders""")
def derive_columns_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    out = H.derive_columns(o, [
        {"target_column": "yearly", "expression": "o_totalprice * 12"},
        {"target_column": "third", "expression": "o_custkey / 3.0"},
        {"target_column": "nested", "expression": "850 - (third * 12.5)"},
    ])
    return out.select(
        "o_orderkey", rounded(F.col("yearly"), 4).alias("yearly"),
        rounded(F.col("third"), 6).alias("third"), rounded(F.col("nested"), 6).alias("nested"),
    )


@query("coerce_events_props", """
SELECT event_id, coalesce(CASE WHEN regexp_matches(t, '^[0-9]+$') THEN CAST(t AS DOUBLE) END, 0.0) AS k,
       event_type, 'UNKNOWN' AS channel, 0.0::DOUBLE AS weight
FROM (SELECT event_id, event_type,
        CASE WHEN value < 5 THEN json_extract_string(props, '$.k') || 'd'
             WHEN value < 10 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS t FROM events)""")
def coerce_events_props(spark, sf_dir):
    return H.coerce_features(_messy(spark, sf_dir), [
        Feature("k"), Feature("event_type", CATEGORICAL), Feature("channel", CATEGORICAL),
        Feature("weight"),
    ])


def _messy(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("value") < 5, F.concat(k, F.lit("d"))).when(
        F.col("value") < 10, F.lit("n/a")
    ).otherwise(k)
    return table(spark, sf_dir, "events").select("event_id", text.alias("k"), "event_type")


@query("coerced_counts_events", """
SELECT event_type, 'k' AS feature, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL)
    AS missing, count(*) FILTER (WHERE value < 10) AS unparsable FROM events GROUP BY event_type""")
def coerced_counts_events(spark, sf_dir):
    return H.coerced_counts(_messy(spark, sf_dir), [Feature("k")], ["event_type"])


CREDIT_SQL = """
credit AS (SELECT l_orderkey, l_linenumber, l_quantity * 2.6::DOUBLE AS age,
  l_extendedprice - 2000.0::DOUBLE AS annual_income, 280 + l_quantity * 12.0::DOUBLE AS credit_score,
  l_discount * 31.0::DOUBLE AS debt_to_income_ratio, l_tax * 100000.0::DOUBLE AS loan_amount,
  l_discount * 510.0::DOUBLE AS interest_rate,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS home_ownership,
  l_linestatus AS loan_intent, l_quantity * 1.42::DOUBLE AS employment_history_length
  FROM lineitem)"""


def credit(spark, sf_dir):
    """Every lineitem as a credit application (deterministic arithmetic on its columns)."""
    q, d = F.col("l_quantity"), F.col("l_discount") + 0.0
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (q * 2.6).alias("age"),
        (F.col("l_extendedprice") - 2000.0).alias("annual_income"),
        (280 + q * 12.0).alias("credit_score"), (d * 31.0).alias("debt_to_income_ratio"),
        ((F.col("l_tax") + 0.0) * 100000.0).alias("loan_amount"), (d * 510.0).alias("interest_rate"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("home_ownership"),
        F.col("l_linestatus").alias("loan_intent"), (q * 1.42).alias("employment_history_length"),
    )


@query("validate_orders", f"""
WITH {CREDIT_SQL}, r AS (SELECT l_orderkey, l_linenumber, concat_ws(',',
  CASE WHEN age < 18 THEN 'age:too_low' WHEN age > 120 THEN 'age:too_high' END,
  CASE WHEN annual_income < 0 THEN 'annual_income:too_low' END,
  CASE WHEN credit_score < 300 THEN 'credit_score:too_low' WHEN credit_score > 850 THEN 'credit_score:too_high' END,
  CASE WHEN debt_to_income_ratio > 3.0 THEN 'debt_to_income_ratio:too_high' END,
  CASE WHEN loan_amount <= 0 THEN 'loan_amount:too_low' END,
  CASE WHEN interest_rate > 50 THEN 'interest_rate:too_high' END,
  CASE WHEN home_ownership IS NULL THEN 'home_ownership:missing' END,
  CASE WHEN employment_history_length > 70 THEN 'employment_history_length:too_high' END) AS reasons
  FROM credit)
SELECT l_orderkey, l_linenumber, reasons FROM r""")
def validate_orders(spark, sf_dir):
    valid, bad = V.validate_records(credit(spark, sf_dir))
    return bad.select(
        "l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons")
    ).unionByName(valid.select("l_orderkey", "l_linenumber", F.lit("").alias("reasons")))


LOG_FEATURES = (Feature("amount"), Feature("urgency", CATEGORICAL), Feature("age"))


@query("to_log_record", f"""
WITH {HARMONIZED} SELECT request_id, "timestamp", 'v7' AS model_version, round(amount, 6) + 0.0 AS amount,
  urgency, 0.0::DOUBLE AS age, 0.25::DOUBLE AS prediction_score, 0::BIGINT AS prediction_label,
  round(125.0 / (SELECT count(*) FROM orders), 3) + 0.0 AS latency_ms FROM h""")
def to_log_record(spark, sf_dir):
    df = harmonized(spark, sf_dir)
    total = df.agg(F.count(F.lit(1)).alias("n"))
    sized = df.crossJoin(F.broadcast(total)).withColumns({  # one row
        "prediction_score": F.lit(0.25), "prediction_label": F.lit(0)
    })
    return _round6(H.to_log_record(sized, LOG_FEATURES, "v7", 125.0, F.col("n")), "amount")


@query("to_long_lineitem", f"""
WITH long AS ({S.long_sql('lineitem', LINEITEM_NUM, 'DOUBLE', ['l_orderkey', 'l_linenumber'])})
SELECT feature, count(*) AS cells, count(DISTINCT value) AS distinct_values, max(value) AS top,
       count(DISTINCT l_orderkey) AS orders FROM long GROUP BY feature""")
def to_long_lineitem(spark, sf_dir):
    long = to_long_numerical(table(spark, sf_dir, "lineitem"), LINEITEM, ["l_orderkey"])
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct("value").alias("distinct_values"),
        F.max("value").alias("top"), F.countDistinct("l_orderkey").alias("orders"),
    )


ORDERS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) + 0.0 AS o_totalprice,
  o_orderpriority FROM orders"""


def orders_plain(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), "o_custkey", "o_orderstatus",
        rounded(F.col("o_totalprice"), 2).alias("o_totalprice"), "o_orderpriority",
    )


ORDER_TYPES = {"o_orderkey": "long", "o_custkey": "long"}


def _typed(df):
    return df.withColumns({c: F.col(c).cast(t) for c, t in ORDER_TYPES.items()}).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )


@query("read_delimited", ORDERS_SQL)
def read_delimited(spark, sf_dir):
    path = workspace(spark, "orders") + ".csv"
    orders_plain(spark, sf_dir).write.option("header", True).option("sep", ";").csv(path)
    return _typed(files.read_any(spark, path))


@query("read_json", ORDERS_SQL)
def read_json(spark, sf_dir):
    path = workspace(spark, "orders") + ".jsonl"
    orders_plain(spark, sf_dir).write.json(path)
    return _typed(files.read_any(spark, path))


@query("read_parquet_projected", "SELECT o_orderkey, o_orderstatus FROM orders")
def read_parquet_projected(spark, sf_dir):
    return files.read_any(
        spark, f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_orderstatus", "absent"]
    )


WINDOW = ("2024-01-10 03:30:00", "2024-01-12 21:15:00")


def event_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp")
    )


@query("write_partitioned", """
SELECT strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day,
       strftime(ts, '%H') AS hour, count(*) AS "rows" FROM events GROUP BY ALL""")
def write_partitioned(spark, sf_dir):
    path = partitions.write_partitioned(
        event_log(spark, sf_dir), workspace(spark, "logs"), time_col="timestamp"
    )
    back = spark.read.parquet(path)
    parts = {c: F.lpad(F.col(c).cast("string"), 4 if c == "year" else 2, "0") for c in partitions.PARTITIONS}
    return back.withColumns(parts).groupBy(*partitions.PARTITIONS).agg(F.count(F.lit(1)).alias("rows"))


@query("scan_window", f"""
SELECT event_id, event_type FROM events
WHERE ts >= TIMESTAMP '{WINDOW[0]}' AND ts <= TIMESTAMP '{WINDOW[1]}'""")
def scan_window(spark, sf_dir):
    path = partitions.write_partitioned(
        event_log(spark, sf_dir), workspace(spark, "logs"), time_col="timestamp"
    )
    return partitions.scan_window(spark, path, *WINDOW, columns=["event_id", "event_type", "absent"])


@query("window_query", f"""
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
WHERE ts >= TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}' GROUP BY event_type""")
def window_query(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("window_query_events")
    return ingest.read_window_query(spark, """
        SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM window_query_events
        WHERE ts >= CAST(:window_start AS TIMESTAMP) AND ts < CAST(:window_end AS TIMESTAMP)
        GROUP BY event_type""", *WINDOW)


@query("ingest_new_files", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS o_custkey,
       o_orderstatus FROM orders WHERE o_orderstatus <> 'O'""")
def ingest_new_files(spark, sf_dir):
    """Two passes over a folder: open orders are known after the first, the rest is new."""
    base = workspace(spark, "incoming")
    o = table(spark, sf_dir, "orders")
    o.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderstatus").write.option(
        "header", True).csv(f"{base}/a")
    _, ledger = ingest.ingest_new_files(spark, f"{base}/*/*.csv")
    kept = f"{base}/ledger"
    ledger.write.parquet(kept)
    o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus").write.option(
        "header", True).csv(f"{base}/b")
    o.filter("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", "o_orderstatus").write.option(
        "header", True).option("sep", "\t").csv(f"{base}/c")
    rows, _ = ingest.ingest_new_files(spark, f"{base}/*/*.csv", spark.read.parquet(kept))
    return rows.select(
        F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus"
    )


@query("ingest_hostile_files", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'café ' || o_orderkey END AS note,
       (SELECT count(DISTINCT o_orderstatus) FROM orders)::BIGINT AS done FROM orders""")
def ingest_hostile_files(spark, sf_dir):
    """One folder with a space in its name, a Latin-1 body under an ASCII header, Parquet files whose types clash, a
    damaged file and a malformed JSON line: every sound row once, and only sound files in the ledger."""
    import warnings

    base = workspace(spark, "hostile") + "/in coming"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    one = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.concat(F.lit("café "), "o_orderkey").alias("note"))
    one.coalesce(1).write.options(header=True, encoding="ISO-8859-1").csv(f"{base}/a")
    o.filter("o_orderstatus = 'O'").select("o_orderkey").coalesce(1).write.parquet(f"{base}/b")
    o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string")).coalesce(1).write.parquet(f"{base}/c")
    o.limit(2).select(F.lit("PAR1 is not enough").alias("value")).coalesce(1).write.text(f"{base}/d")
    o.limit(1).select(F.lit('{"o_orderkey": 1').alias("value")).coalesce(1).write.text(f"{base}/e")
    fs = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder, ending in (("d", "parquet"), ("e", "jsonl")):  # text written under another ending
        for status in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}")):
            if status.getPath().getName().endswith(".txt"):
                fs.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}/file.{ending}"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the damaged files are the case
        rows, ledger = ingest.ingest_new_files(spark, f"{base}/*/*.*")
        again, _ = ingest.ingest_new_files(spark, f"{base}/*/*.*", ledger)
    assert again is None, "a file was read twice"
    return rows.select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"), "note", F.lit(ledger.count()).cast("long").alias("done")
    )


@query("ingest_end_to_end", f"""
WITH {HARMONIZED} SELECT request_id, source_id, round(amount, 6) + 0.0 AS amount, urgency,
  'SUCCESS' AS status, (SELECT count(*) FROM orders) AS record_count FROM h""")
def ingest_end_to_end(spark, sf_dir):
    import warnings

    path = workspace(spark, "logs")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the broken derivation is part of the case
        result = ingest.ingest(
            spark, f"{sf_dir}/orders.parquet", ORDER_MAPPING, ORDER_FEATURES, path, now=NOW,
            batch_time="2024-02-01 05:00:00",
        )
    back = spark.read.parquet(f"{path}/year=2024/month=02/day=01/hour=05")
    return _round6(back.select("request_id", "source_id", "amount", "urgency"), "amount").withColumns({
        "status": F.lit(result.status), "record_count": F.lit(result.record_count).cast("long"),
    })


@query("baseline_store", f"""
WITH ref_long AS ({S.long_sql('lineitem', LINEITEM_NUM, 'DOUBLE')}),{S.bins_sql()}
SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY e) - 1 AS INTEGER) AS i,
       round(e, 4) + 0.0 AS edge FROM edges""")
def baseline_store(spark, sf_dir):
    from siltmark.operators.baseline import build_baseline
    from siltmark.sources.artifacts import load_baseline, save_baseline

    df = table(spark, sf_dir, "lineitem")
    bins, sample = build_baseline(df, LINEITEM, ["l_orderkey", "l_linenumber"])
    path = save_baseline(bins, sample, workspace(spark, "baseline"), "v1")
    back, _ = load_baseline(spark, path, "v1")
    return back.filter("feature_type = 'numerical'").select(
        "feature", F.posexplode("bin_edges").alias("i", "edge")
    ).withColumn("edge", F.col("edge") + 0.0)


@query("late_events", """
SELECT event_id, event_type, ts AS "timestamp" FROM events
WHERE ts >= TIMESTAMP '2024-01-12 00:00:00' AND ts < TIMESTAMP '2024-01-14 12:00:00'""")
def late_events(spark, sf_dir):
    """Purchases are stored a day after they happen; the zone map finds them all the same."""
    from siltmark.sources.zones import scan_events

    e = table(spark, sf_dir, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    stored = F.col("timestamp") + F.when(F.col("event_type") == "purchase", F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    path = f"{workspace(spark, 'late')}/log"
    partitions.write_partitioned(e.withColumn("stored", stored).select("event_id", "event_type", "timestamp", "stored"), path, time_col="stored")
    out = scan_events(spark, path, "2024-01-12 00:00:00", "2024-01-14 12:00:00", inclusive_end=False)
    return out.select("event_id", "event_type", "timestamp")


STATES_SQL = f"""
{EVENTS_SQL}, span AS (SELECT * FROM ev
  WHERE "timestamp" >= TIMESTAMP '2024-01-03 00:00:00' AND "timestamp" < TIMESTAMP '2024-01-20 12:00:00')"""


def event_states(spark, sf_dir):
    """States of all events in two batches: purchases come later, and their batch comes twice."""
    from siltmark.operators.states import StateStore

    store = StateStore(spark, workspace(spark, "states"))
    rows = events(spark, sf_dir)
    late = F.col("event_type") == "purchase"
    store.add("first", rows.filter(~late | late.isNull()), EVENTS)
    store.add("late", rows.filter(late), EVENTS)
    store.add("late", rows.filter(late), EVENTS)
    return store


SPAN = ("2024-01-03 00:00:00", "2024-01-20 12:00:00")


@query("baseline_states_events", f"""
WITH {STATES_SQL}, cells AS (
  SELECT 'value' AS feature, value AS v FROM span UNION ALL SELECT 'k', try_cast(k AS DOUBLE) FROM span)
SELECT feature, count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 3) + 0.0 AS mean,
       round(stddev_pop(v), 3) + 0.0 AS std, min(v) AS min, max(v) AS max,
       TRUE AS quantiles_within_bound, TRUE AS distinct_within_bound
FROM cells GROUP BY feature""")
def baseline_states_events(spark, sf_dir):
    """A baseline from hourly states; its quantiles and distinct counts are held against the rows."""
    from siltmark.operators.longform import to_long_numerical
    from siltmark.operators.states import measured_rank_error, rank_error

    merged = event_states(spark, sf_dir).numerical_baseline(*SPAN)
    at = F.col("timestamp")
    rows = events(spark, sf_dir).filter((at >= F.lit(SPAN[0]).cast("timestamp")) & (at < F.lit(SPAN[1]).cast("timestamp")))
    exact = to_long_numerical(rows, EVENTS).groupBy("feature").agg(F.count_distinct("value").alias("distinct_exact"))
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_exact")) <= 0.07 * F.col("distinct_exact")
    return merged.join(measured_rank_error(rows, EVENTS, merged), "feature").join(exact, "feature").select(
        "feature", "n", "missing", *[(F.round(c, 3) + 0.0).alias(c) for c in ("mean", "std")], "min", "max",
        (F.col("rank_error") <= 2 * rank_error()).alias("quantiles_within_bound"), off.alias("distinct_within_bound"),
    )


@query("category_states_events", f"""
WITH {STATES_SQL}, seen AS (SELECT event_type AS category, count(*) AS c FROM span WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT 'event_type' AS feature, category, c AS "count", round(c / sum(c) OVER (), 5) + 0.0 AS share FROM seen""")
def category_states_events(spark, sf_dir):
    return event_states(spark, sf_dir).category_shares(*SPAN)
