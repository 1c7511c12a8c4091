"""Registered queries: training tables, scoring, evaluation, registry, backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.config import CREDIT_FEATURES, Feature
from siltmark.functions.columns import rounded
from siltmark.operators import drift, evaluation, model
from siltmark.plans import twins as S
from siltmark.plans.datasets import EVENTS, events_sides
from siltmark.plans.queries_drift import WINDOW_PSI
from siltmark.plans.queries_ingest import CREDIT_SQL, credit
from siltmark.plans.registry import query, table
from siltmark.sources.workspace import stored

FEATURES = (
    Feature("l_quantity"), Feature("l_extendedprice"), Feature("l_discount"),
    Feature("l_linestatus", "categorical"),
)


def sides(spark, sf_dir):
    """Older shipments as baseline with a target, newer ones as logs with a score."""
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        (F.col("l_discount") + 0.0).alias("l_discount"), "l_linestatus", "l_returnflag", "l_shipdate",
        "l_tax",
    )
    cut = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    base = df.filter(cut).withColumn(
        "target", F.when(F.col("l_returnflag") != "A", (F.col("l_returnflag") == "R").cast("int"))
    )
    logs = df.filter(~cut).withColumn("prediction_score", F.col("l_tax") * 10)
    return base.drop("l_tax"), logs.drop("l_tax")


TRAINING_SQL = """
base AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount,
   l_linestatus, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 0 ELSE 0 END AS label
   FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'),
logs AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount,
   l_linestatus, CASE WHEN l_tax * 10 >= 0.5 THEN 1 ELSE 0 END AS label
   FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'),
training AS (SELECT * FROM base UNION ALL SELECT * FROM logs)"""


def training(spark, sf_dir):
    base, logs = sides(spark, sf_dir)
    return model.training_set(base, logs, FEATURES, ["l_orderkey", "l_linenumber"])


@query("training_set", f"WITH {TRAINING_SQL} SELECT * FROM training")
def training_set(spark, sf_dir):
    return training(spark, sf_dir)


@query("stratified_split", f"""
WITH {TRAINING_SQL}, keyed AS (SELECT *, CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber
    || '|' || l_quantity || '|' || l_extendedprice || '|42'), 1, 13) AS BIGINT) AS h,
    count(*) OVER (PARTITION BY label) AS n FROM training),
ranked AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY h) AS r,
                  count(*) OVER (PARTITION BY label, h) AS same FROM keyed)
SELECT label, count(*) FILTER (WHERE r <= round(n * 0.25)) AS validation, count(*) AS "rows"
FROM ranked GROUP BY label""")
def stratified_split(spark, sf_dir):
    split = model.stratified_split(
        training(spark, sf_dir), "label",
        ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
    )
    return split.groupBy("label").agg(
        F.count_if("is_validation").alias("validation"), F.count(F.lit(1)).alias("rows")
    )


@query("stratified_split_orders", """
WITH keyed AS (SELECT o_orderkey, o_orderstatus AS label,
    CAST('0x' || substr(md5(o_orderkey || '|42'), 1, 13) AS BIGINT) AS h,
    count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, label,
       row_number() OVER (PARTITION BY label ORDER BY h) <= round(n * 0.25) AS is_validation FROM keyed""")
def stratified_split_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    return model.stratified_split(o, "label", ["o_orderkey"]).select(
        "o_orderkey", "label", "is_validation"
    )


@query("impute_scale", """
WITH t AS (SELECT event_id, CASE WHEN value < 60 THEN value END AS value FROM events),
f AS (SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM t)) AS v FROM t)
SELECT event_id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) + 0.0 AS value FROM f""")
def impute_scale(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("value") < 60, F.col("value")).alias("value")
    )
    return model.impute_and_scale(e, [Feature("value")]).withColumn(
        "value", rounded(F.col("value"), 6)
    )


HEURISTIC_SQL = """
scored AS (SELECT *, least(greatest(0.2::DOUBLE
  + CASE WHEN credit_score < 580 THEN 0.35 WHEN credit_score < 670 THEN 0.15 ELSE 0.0 END::DOUBLE
  + CASE WHEN debt_to_income_ratio > 0.45 THEN 0.25 ELSE 0.0 END::DOUBLE
  + CASE WHEN loan_amount / greatest(annual_income, 1000.0) > 0.4 THEN 0.2 ELSE 0.0 END::DOUBLE, 0.01), 0.99)
  AS score, 1.0 / (1.0 + exp((credit_score - 620.0) / 60.0)) AS logistic FROM credit)"""


@query("heuristic_score", f"""
WITH {CREDIT_SQL},{HEURISTIC_SQL}
SELECT round(score, 6) AS score, count(*) AS "rows", round(min(credit_score), 3) AS low,
       round(max(credit_score), 3) AS high FROM scored GROUP BY 1""")
def heuristic_score(spark, sf_dir):
    c = credit(spark, sf_dir)
    return c.groupBy(rounded(model.heuristic_score(c), 6).alias("score")).agg(
        F.count(F.lit(1)).alias("rows"), rounded(F.min("credit_score"), 3).alias("low"),
        rounded(F.max("credit_score"), 3).alias("high"),
    )


@query("logistic_score", f"""
WITH {CREDIT_SQL},{HEURISTIC_SQL}
SELECT credit_score, round(any_value(logistic), 8) AS prediction_score,
       max(CASE WHEN logistic >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS prediction_label,
       count(*) AS "rows" FROM scored GROUP BY credit_score""")
def logistic_score(spark, sf_dir):
    c = credit(spark, sf_dir)
    scored = model.with_label(c.withColumn("prediction_score", model.logistic_fallback_score(c)))
    return scored.groupBy("credit_score").agg(
        rounded(F.max("prediction_score"), 8).alias("prediction_score"),
        F.max("prediction_label").alias("prediction_label"), F.count(F.lit(1)).alias("rows"),
    )


SCORED_SQL = """
scored AS (
  SELECT 'champion' AS model, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         l_quantity / 50.0::DOUBLE AS score FROM lineitem
  UNION ALL
  SELECT 'challenger', CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END,
         least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_extendedprice / 105000.0::DOUBLE
           + CASE WHEN l_returnflag = 'R' THEN 0.02 ELSE 0.0 END::DOUBLE)) FROM lineitem),
ranked AS (SELECT model, label, score, sum(label) OVER m AS p, count(*) OVER m AS n,
             rank() OVER s + (count(*) OVER t - 1) / 2.0 AS mid
           FROM scored WINDOW m AS (PARTITION BY model), s AS (PARTITION BY model ORDER BY score),
             t AS (PARTITION BY model, score)),
auc AS (SELECT model, (sum(CASE WHEN label = 1 THEN mid ELSE 0 END) - max(p) * (max(p) + 1) / 2.0)
          / (max(p)::DOUBLE * (max(n) - max(p))) AS roc_auc FROM ranked GROUP BY model),
by_score AS (SELECT model, score, sum(label) AS pos, count(*) AS c FROM scored GROUP BY model, score),
prec AS (SELECT model, pos, sum(pos) OVER d / sum(c) OVER d AS pr, sum(pos) OVER (PARTITION BY model) AS p
         FROM by_score WINDOW d AS (PARTITION BY model ORDER BY score DESC)),
ap AS (SELECT model, sum(pos * pr / p) AS pr_auc FROM prec GROUP BY model),
cut AS (SELECT model, 2.0 * count(*) FILTER (WHERE label = 1 AND score >= 0.5)
          / (count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE score >= 0.5)) AS f1_score,
          avg(-ln(CASE WHEN label = 1 THEN least(greatest(score, 1e-6), 1 - 1e-6)
                  ELSE 1.0 - least(greatest(score, 1e-6), 1 - 1e-6) END)) AS log_loss
        FROM scored GROUP BY model),
metrics AS (SELECT model, round(roc_auc, 4) AS roc_auc, round(pr_auc, 4) AS pr_auc,
   round(f1_score, 4) AS f1_score, round(log_loss, 4) AS log_loss
   FROM auc JOIN ap USING (model) JOIN cut USING (model))"""


def both_models(spark, sf_dir, *keep):
    """Both models score every lineitem; scored in one pass, exploded to one row per model."""
    df = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    second = F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), F.col("l_extendedprice") / 105000.0 + F.when(returned, 0.02).otherwise(0.0)
    ))
    pairs = F.array(
        F.struct(F.lit("champion").alias("model"), (F.col("l_quantity") / 50.0).alias("score")),
        F.struct(F.lit("challenger").alias("model"), second.alias("score")),
    )
    return df.select(*keep, returned.cast("int").alias("label"), F.inline(pairs))


@query("roc_auc", f"WITH {SCORED_SQL} SELECT model, round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(spark, sf_dir):
    m = evaluation.ranking_metrics(both_models(spark, sf_dir), "score", "label")
    return m.select("model", rounded(F.col("roc_auc"), 6).alias("roc_auc"))


@query("average_precision", f"WITH {SCORED_SQL} SELECT model, round(pr_auc, 6) AS pr_auc FROM ap")
def average_precision(spark, sf_dir):
    m = evaluation.ranking_metrics(both_models(spark, sf_dir), "score", "label")
    return m.select("model", rounded(F.col("pr_auc"), 6).alias("pr_auc"))


@query("f1", f"WITH {SCORED_SQL} SELECT model, round(f1_score, 6) AS f1_score FROM cut")
def f1(spark, sf_dir):
    m = evaluation.threshold_metrics(both_models(spark, sf_dir), "score", "label")
    return m.select("model", rounded(F.col("f1_score"), 6).alias("f1_score"))


@query("log_loss", f"WITH {SCORED_SQL} SELECT model, round(log_loss, 6) AS log_loss FROM cut")
def log_loss(spark, sf_dir):
    m = evaluation.threshold_metrics(both_models(spark, sf_dir), "score", "label")
    return m.select("model", rounded(F.col("log_loss"), 6).alias("log_loss"))


@query("binary_metrics", f"WITH {SCORED_SQL} SELECT * FROM metrics")
def binary_metrics(spark, sf_dir):
    return evaluation.binary_metrics(both_models(spark, sf_dir))


@query("binary_metrics_gaps", "WITH " + SCORED_SQL.replace(
    "FROM lineitem", "FROM lineitem WHERE l_linestatus <> 'O' AND l_linenumber <> 7"
) + " SELECT * FROM metrics")
def binary_metrics_gaps(spark, sf_dir):
    """Rows whose score is NULL or NaN take no part."""
    gap = F.when(F.col("l_linestatus") == "O", F.lit(None)).when(F.col("l_linenumber") == 7, F.lit(float("nan")))
    rows = both_models(spark, sf_dir, "l_linestatus", "l_linenumber")
    return evaluation.binary_metrics(
        rows.withColumn("score", F.when((F.col("l_linestatus") == "O") | (F.col("l_linenumber") == 7), gap).otherwise(F.col("score")))
    )


@query("champion_challenger", f"""
WITH {SCORED_SQL}, c AS (SELECT * FROM metrics WHERE model = 'champion'),
n AS (SELECT * FROM metrics WHERE model = 'challenger')
SELECT c.roc_auc AS champion_roc_auc, c.f1_score AS champion_f1_score, c.pr_auc AS champion_pr_auc,
  c.log_loss AS champion_log_loss, n.roc_auc AS challenger_roc_auc, n.pr_auc AS challenger_pr_auc,
  n.f1_score AS challenger_f1_score, n.log_loss AS challenger_log_loss,
  round(n.roc_auc - c.roc_auc, 4) + 0.0 AS delta_roc_auc,
  round(n.f1_score - c.f1_score, 4) + 0.0 AS delta_f1_score,
  round(n.log_loss - c.log_loss, 4) + 0.0 AS delta_log_loss,
  CASE WHEN round(n.roc_auc - c.roc_auc, 9) >= -0.03 THEN 'APPROVED' ELSE 'REJECTED' END AS verdict
FROM c, n""")
def champion_challenger(spark, sf_dir):
    metrics = evaluation.binary_metrics(both_models(spark, sf_dir))
    return evaluation.champion_challenger(metrics).drop("reason")


def registry(spark, sf_dir):
    """Orders as a history of pointers: the customer number is the version."""
    o = table(spark, sf_dir, "orders")
    v = F.concat(F.lit("v"), F.col("o_custkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("seq"), v.alias("version"),
        F.concat(F.lit("v"), F.floor(F.col("o_custkey") / 2).cast("string")).alias("previous_version"),
        F.concat(v, F.lit("/model")).alias("model_path"),
        F.when(F.col("o_orderstatus") == "P", "FORCED").otherwise("APPROVED").alias("verdict"),
        F.lit(False).alias("is_rollback"), F.col("o_orderdate").cast("timestamp").alias("promoted_at"),
    )


@query("promote_registry", """
WITH last AS (SELECT o_orderkey AS seq, 'v' || o_custkey AS version, 'v' || (o_custkey // 2) AS previous
              FROM orders ORDER BY o_orderkey DESC LIMIT 1),
nxt AS (SELECT 'v' || (max(greatest(o_custkey, o_custkey // 2)) + 1) AS version FROM orders)
SELECT 'promote' AS action, seq + 1 AS seq, nxt.version AS version, last.version AS previous_version,
       nxt.version || '/model' AS model_path, FALSE AS is_rollback FROM last, nxt
UNION ALL
SELECT 'rollback', seq + 1, previous, version, previous || '/model', TRUE FROM last""")
def promote_registry(spark, sf_dir):
    reg = registry(spark, sf_dir)
    verdicts = model.next_version(reg).select(
        F.col("next_version").alias("candidate_version"), F.lit("APPROVED").alias("verdict")
    )
    columns = ["seq", "version", "previous_version", "model_path", "is_rollback"]
    up = model.promote(reg, verdicts, "2024-02-01 00:00:00").select(F.lit("promote").alias("action"), *columns)
    down = model.rollback(reg, "2024-02-01 00:00:00").select(F.lit("rollback").alias("action"), *columns)
    return up.unionByName(down)


@query("refresh_baseline", f"""
WITH v AS (SELECT o_totalprice AS amount, o_custkey / 15000.0::DOUBLE AS prediction_score FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderstatus
              ORDER BY CAST('0x' || substr(md5(o_orderkey || '|42'), 1, 13) AS BIGINT)) AS r,
           count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE r <= round(n * 0.25)),
ref_long AS ({S.long_sql('v', ['amount'], 'DOUBLE')}),{S.bins_sql()},{S.BINS_FROM_EDGES},
{S.histogram_sql('h', 'ref_long')}
SELECT feature, CAST(bin AS INTEGER) AS bin, round(c / n, 5) + 0.0 AS share FROM h
UNION ALL
SELECT 'prediction_score', CAST(b AS INTEGER), round(count(*) FILTER (WHERE prediction_score >= b / 10.0::DOUBLE
   AND (prediction_score < (b + 1) / 10.0::DOUBLE OR (b = 9 AND prediction_score <= 1.0))) / count(*), 5) + 0.0
FROM v, range(0, 10) t(b) GROUP BY b""")
def refresh_baseline(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("amount"),
        (F.col("o_custkey") / 15000.0).alias("prediction_score"),
    )
    split = model.stratified_split(o, "o_orderstatus", ["o_orderkey"])
    bins, _ = model.refresh_baseline(
        split.filter("is_validation"), [Feature("amount")], ["o_orderkey"]
    )
    return bins.select("feature", F.posexplode("baseline_percentages").alias("bin", "share")).withColumn(
        "share", rounded(F.col("share"), 5)
    )


@query("train_score")
def train_score(spark, sf_dir):
    """Train on credit records labelled by the rule-based score, then evaluate the model."""
    c = credit(spark, sf_dir).fillna({"home_ownership": "OTHER"})
    c = stored(c.withColumn("label", (model.heuristic_score(c) >= 0.5).cast("int")), "labelled", model.PASS_ROWS)
    split = stored(model.stratified_split(c, "label", ["l_orderkey", "l_linenumber", "annual_income"]), "split", model.PASS_ROWS)
    features = [f for f in CREDIT_FEATURES if f.name in c.columns]
    fitted = model.train_challenger(
        split.filter("NOT is_validation"), features
    )
    scored = model.score_batch(split.filter("is_validation"), fitted, "v1")
    rows = scored.select(F.lit("challenger").alias("model"), "label",
                         F.col("prediction_score").alias("score"))
    return evaluation.binary_metrics(stored(rows, "scored", model.PASS_ROWS))


EPISODES_SQL = f"""{WINDOW_PSI},
lab AS (SELECT window_start, hour(window_start) < 12 AS drifted FROM cur GROUP BY window_start),
j AS (SELECT window_start, psi >= 0.2 AS hit, drifted FROM psi_all JOIN lab USING (window_start) WHERE feature = 'value'),
d AS (SELECT *, coalesce(lag(window_start) OVER (ORDER BY window_start) + INTERVAL 6 HOUR < window_start, TRUE)::INT AS fresh
      FROM j WHERE drifted),
n AS (SELECT *, sum(fresh) OVER (ORDER BY window_start) AS episode FROM d),
episodes AS (SELECT episode::INT AS episode, min(window_start) AS onset, max(window_start) + INTERVAL 6 HOUR AS "end", count(*) AS windows,
               min(window_start) FILTER (WHERE hit) AS first_hit,
               round(date_diff('second', min(window_start), min(window_start) FILTER (WHERE hit) + INTERVAL 6 HOUR) / 3600.0, 4) + 0.0
                 AS delay_hours
             FROM n GROUP BY episode)"""


def labelled_series(spark, sf_dir):
    """Index of ``value`` per window; the morning windows are labelled as drifted."""
    ref, cur = events_sides(spark, sf_dir)
    series = drift.window_drift_series(ref, cur, EVENTS).filter("feature = 'value'")
    return series, series.select("window_start", (F.hour("window_start") < 12).alias("drifted"))


@query("drift_episodes", f"WITH {EPISODES_SQL} SELECT * FROM episodes")
def drift_episodes(spark, sf_dir):
    return evaluation.drift_episodes(*labelled_series(spark, sf_dir))


@query("detector_backtest", f"""
WITH {EPISODES_SQL},
e AS (SELECT count(*) AS episodes, count(first_hit) AS detected_episodes, round(avg(delay_hours), 4) + 0.0 AS detection_delay_hours
      FROM episodes)
SELECT count(*) FILTER (WHERE NOT drifted) AS clean_windows, count(*) FILTER (WHERE drifted) AS drifted_windows,
  count(*) FILTER (WHERE NOT drifted AND hit) AS false_alarms, count(*) FILTER (WHERE drifted AND hit) AS detected,
  round(count(*) FILTER (WHERE NOT drifted AND hit) * 100.0 / greatest(count(*) FILTER (WHERE NOT drifted), 1), 2)
    + 0.0 AS false_alarm_rate_pct,
  round(count(*) FILTER (WHERE drifted AND hit) * 100.0 / greatest(count(*) FILTER (WHERE drifted), 1), 2)
    + 0.0 AS sensitivity_pct, (SELECT episodes FROM e) AS episodes, (SELECT detected_episodes FROM e) AS detected_episodes,
  (SELECT detection_delay_hours FROM e) AS detection_delay_hours FROM j""")
def detector_backtest(spark, sf_dir):
    return evaluation.detector_backtest(*labelled_series(spark, sf_dir))
