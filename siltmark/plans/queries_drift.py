"""Registered queries: histograms, PSI, KS, chi-square, profiles, baselines, drift tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.config import CATEGORICAL, Feature
from siltmark.functions.columns import rounded, unwrapped, wrapped
from siltmark.operators import baseline as B
from siltmark.operators import binning, chi2, drift, ks, profile, psi
from siltmark.operators.longform import (
    to_long_categorical,
    to_long_numerical,
    with_window,
)
from siltmark.plans import twins as S
from siltmark.plans.datasets import (
    EVENTS_SQL,
    EVENTS,
    EVENTS_SIDES_SQL,
    LINEITEM,
    LINEITEM_CAT,
    LINEITEM_NUM,
    LINEITEM_SIDES_SQL,
    ORDERS_SIDES_SQL,
    events_sides,
    lineitem_sides,
    orders_sides,
)
from siltmark.plans.registry import query, table

ORDER_FEATURES = (
    Feature("o_orderpriority", CATEGORICAL, "high", allowed_values=(
        "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER")),
    Feature("o_orderstatus", CATEGORICAL, "medium", allowed_values=("F", "O", "P")),
)
ORDER_CAT = [f.name for f in ORDER_FEATURES]
PSI_NUM = S.psi_numerical_ctes("ref", "cur", LINEITEM_NUM)


@query("psi_numerical_lineitem", f"""
WITH {LINEITEM_SIDES_SQL},{PSI_NUM},{S.psi_sum_sql()}
SELECT feature, psi, {S.STATUS} AS status, ref_n, cur_n, degenerate_bins FROM psi_num""")
def psi_numerical_lineitem(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return psi.psi_numerical(ref, cur, LINEITEM).select(
        "feature", "psi", drift.feature_status(F.col("psi")).alias("status"),
        "ref_n", "cur_n", "degenerate_bins",
    )


@query("psi_breakdown_lineitem", f"""
WITH {LINEITEM_SIDES_SQL},{PSI_NUM},
{S.category_ctes('ref', 'cur', LINEITEM_CAT)},
rows_ AS (
 SELECT feature, 'numerical' AS feature_type, CAST(bin AS INTEGER) AS bin,
   '[' || CASE WHEN bin = 0 THEN '-inf' ELSE printf('%.2f', low) END || ', '
       || CASE WHEN bin = k - 1 THEN '+inf' ELSE printf('%.2f', high) END || ']' AS label,
   round(rc / rn, 5) + 0.0 AS baseline_pct, round(cc / cn, 5) + 0.0 AS production_pct,
   round(comp, 5) + 0.0 AS psi_component FROM terms WHERE comp IS NOT NULL
 UNION ALL
 SELECT feature, 'categorical', NULL, category, round(rc / rn, 5) + 0.0, round(cc / cn, 5) + 0.0,
   round(comp, 5) + 0.0 FROM cat_terms WHERE comp IS NOT NULL)
SELECT *, CASE WHEN psi_component > 0.05 THEN 'high' WHEN psi_component > 0.02 THEN 'medium'
               ELSE 'low' END AS band FROM rows_""")
def psi_breakdown_lineitem(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return psi.psi_breakdown(ref, cur, LINEITEM)


@query("quantile_edges_lineitem", f"""
WITH ref_long AS ({S.long_sql('lineitem', LINEITEM_NUM, 'DOUBLE')}),{S.bins_sql()}
SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY e) - 1 AS INTEGER) AS i,
       round(e, 4) + 0.0 AS edge FROM edges""")
def quantile_edges_lineitem(spark, sf_dir):
    long = to_long_numerical(table(spark, sf_dir, "lineitem"), LINEITEM)
    edges = binning.quantile_bin_edges(long)
    return edges.select("feature", F.posexplode("bin_edges").alias("i", "edge")).withColumn(
        "edge", rounded(F.col("edge"), 4)
    )


@query("histogram_lineitem", f"""
WITH {LINEITEM_SIDES_SQL},{PSI_NUM}
SELECT feature, CAST(bin AS INTEGER) AS bin, round(low, 4) + 0.0 AS low,
       round(high, 4) + 0.0 AS high, c AS "count", n FROM cur_h""")
def histogram_lineitem(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    edges = binning.quantile_bin_edges(to_long_numerical(ref, LINEITEM))
    rows = binning.histogram_by_edges(to_long_numerical(cur, LINEITEM), edges)
    return rows.withColumns({c: rounded(F.col(c), 4) for c in ("low", "high")})


@query("psi_categorical_lineitem", f"""
WITH {LINEITEM_SIDES_SQL},{S.category_ctes('ref', 'cur', LINEITEM_CAT)},{S.psi_cat_sum_sql()}
SELECT * FROM psi_cat""")
def psi_categorical_lineitem(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return psi.psi_categorical(ref, cur, LINEITEM)


LISTED_EVENTS = """SELECT 'event_type' AS feature, unnest(['click', 'purchase', 'view']) AS category"""


DOCUMENT_SIDES_SQL = """
ref AS (SELECT source, doc_id::VARCHAR AS doc_id, lang FROM documents WHERE n_chars < 2000),
cur AS (SELECT source, doc_id::VARCHAR AS doc_id, lang FROM documents WHERE n_chars >= 1000)"""


@query("categories_by_source_documents", f"""
WITH {DOCUMENT_SIDES_SQL},{S.category_ctes('ref', 'cur', ['doc_id', 'lang'], ['source'])},{S.psi_cat_sum_sql(['source'])},
c AS (SELECT *, rc + 1.0::DOUBLE AS r1, cc + 1.0::DOUBLE AS c1 FROM cells),
t AS (SELECT *, sum(r1) OVER f AS rt, sum(c1) OVER f AS ct FROM c WINDOW f AS (PARTITION BY source, feature)),
e AS (SELECT *, abs(r1 - (r1 + c1) * rt / (rt + ct)) AS gap FROM t),
h AS (SELECT source, feature, CAST(max(k) - 1 AS BIGINT) AS dof,
        round(sum(power(gap - CASE WHEN k = 2 THEN least(0.5, gap) ELSE 0 END, 2)
                  * ((rt + ct) / ((r1 + c1) * rt) + (rt + ct) / ((r1 + c1) * ct))), 4) + 0.0 AS chi2_statistic
      FROM e GROUP BY source, feature)
SELECT h.source, h.feature, psi, ref_n, cur_n, dof, chi2_statistic
FROM psi_cat JOIN h ON h.source IS NOT DISTINCT FROM psi_cat.source AND h.feature = psi_cat.feature""")
def categories_by_source_documents(spark, sf_dir):
    """A category per document against one shared baseline, for every source: a vocabulary as large as the table."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    ref, cur = docs.filter("n_chars < 2000"), docs.filter("n_chars >= 1000")
    features = [Feature("doc_id", CATEGORICAL), Feature("lang", CATEGORICAL)]
    index = psi.psi_categorical(ref, cur, features, keys=["source"]).drop("degenerate_bins")
    test = chi2.chi2_homogeneity(ref, cur, features, ["source"], p_value=False).drop("ref_n", "cur_n")
    keyed = [wrapped(x, ["source"]) for x in (index, test)]
    return unwrapped(keyed[0].join(keyed[1], ["source", "feature"]), ["source"])


@query("psi_categorical_unseen_events", f"""
WITH {EVENTS_SIDES_SQL},{S.category_ctes('ref', 'cur', ['event_type'], ['day'], LISTED_EVENTS)},
{S.psi_cat_sum_sql(['day'])}
SELECT * FROM psi_cat""")
def psi_categorical_unseen_events(spark, sf_dir):
    ref, cur = events_sides(spark, sf_dir)
    cur = cur.withColumn("day", F.date_trunc("day", "timestamp"))
    feature = EVENTS[2]
    listed = spark.createDataFrame(
        [(feature.name, sorted(feature.allowed_values))], "feature string, categories array<string>"
    )
    return psi.psi_categorical(ref, cur, [feature], listed, keys=["day"])


@query("category_frequencies_orders", f"""
WITH long AS ({S.long_sql('orders', ORDER_CAT, 'VARCHAR')}),
seen AS (SELECT feature, value AS category, count(*) AS c FROM long GROUP BY ALL),
listed AS (SELECT 'o_orderpriority' AS feature, unnest(['1-URGENT', '2-HIGH', '3-MEDIUM',
             '4-NOT SPECIFIED', '5-LOW', '6-NEVER']) AS category
           UNION ALL SELECT 'o_orderstatus', unnest(['F', 'O', 'P'])),
tot AS (SELECT feature, sum(c)::BIGINT AS n FROM seen GROUP BY feature)
SELECT feature, category, coalesce(c, 0) AS "count", n, round(coalesce(c, 0) / n, 5) + 0.0 AS share
FROM seen FULL JOIN listed USING (feature, category) JOIN tot USING (feature)""")
def category_frequencies_orders(spark, sf_dir):
    long = to_long_categorical(table(spark, sf_dir, "orders"), ORDER_FEATURES)
    return binning.category_frequencies(long, ORDER_FEATURES)


@query("ks_lineitem", f"""
WITH {LINEITEM_SIDES_SQL}, ref_long AS ({S.long_sql('ref', LINEITEM_NUM, 'DOUBLE')}),
cur_long AS ({S.long_sql('cur', LINEITEM_NUM, 'DOUBLE')}),{S.ks_ctes()}
SELECT feature, ks_statistic, ref_n, cur_n FROM ks""")
def ks_lineitem(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return ks.ks_two_sample(ref, cur, LINEITEM, p_value=None)


@query("ks_windows_events", f"""
WITH {EVENTS_SIDES_SQL}, ref_long AS ({S.long_sql('ref', ['value', 'k'], 'DOUBLE')}),
cur_long AS ({S.long_sql('cur', ['value', 'k'], 'DOUBLE', ['window_start'])}),{S.ks_ctes(['window_start'])}
SELECT window_start, feature, ks_statistic, ref_n, cur_n FROM ks""")
def ks_windows_events(spark, sf_dir):
    ref, cur = events_sides(spark, sf_dir)
    return ks.ks_two_sample(
        ref, with_window(cur), EVENTS, keys=["window_start"], p_value=None
    )


@query("ks_pvalue_lineitem")
def ks_pvalue_lineitem(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return ks.ks_two_sample(ref, cur, LINEITEM)


@query("chi2_orders", f"""
WITH {ORDERS_SIDES_SQL},{S.category_ctes('ref', 'cur', ORDER_CAT)},{S.CHI2}
SELECT * FROM chi2""")
def chi2_orders(spark, sf_dir):
    ref, cur = orders_sides(spark, sf_dir)
    return chi2.chi2_homogeneity(ref, cur, ORDER_FEATURES, p_value=False)


@query("chi2_lineitem", f"""
WITH {LINEITEM_SIDES_SQL},{S.category_ctes('ref', 'cur', LINEITEM_CAT)},{S.CHI2}
SELECT * FROM chi2""")
def chi2_lineitem(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return chi2.chi2_homogeneity(ref, cur, LINEITEM, p_value=False)


@query("chi2_pvalue_orders", f"""
WITH {ORDERS_SIDES_SQL},{S.category_ctes('ref', 'cur', ORDER_CAT)},{S.CHI2},{S.CHI2_P}
SELECT * FROM chi2_p""")
def chi2_pvalue_orders(spark, sf_dir):
    ref, cur = orders_sides(spark, sf_dir)
    return chi2.chi2_homogeneity(ref, cur, ORDER_FEATURES)


@query("numeric_profile_lineitem", f"""
WITH long AS ({S.long_sql('lineitem', LINEITEM_NUM, 'DOUBLE')})
SELECT feature, round(avg(value), 2) + 0.0 AS mean, round(stddev_samp(value), 2) + 0.0 AS std,
       round(quantile_cont(value, 0.5), 2) + 0.0 AS median, round(min(value), 2) + 0.0 AS min,
       round(max(value), 2) + 0.0 AS max,
       round((count(*) - count(value)) / count(*), 4) + 0.0 AS missing_pct
FROM long GROUP BY feature""")
def numeric_profile_lineitem(spark, sf_dir):
    return profile.numeric_profile(table(spark, sf_dir, "lineitem"), LINEITEM)


@query("baseline_profile_windows_events", f"""
WITH {EVENTS_SIDES_SQL}, cur_long AS ({S.long_sql('cur', ['value', 'k'], 'DOUBLE', ['window_start'])})
SELECT window_start, feature, round(avg(value), 3) + 0.0 AS mean,
       round(stddev_pop(value), 3) + 0.0 AS std,
       round(quantile_cont(value, 0.5), 3) + 0.0 AS median, round(min(value), 3) + 0.0 AS min,
       round(max(value), 3) + 0.0 AS max
FROM cur_long GROUP BY window_start, feature""")
def baseline_profile_windows_events(spark, sf_dir):
    _, cur = events_sides(spark, sf_dir)
    return profile.baseline_profile(with_window(cur), EVENTS, ["window_start"])


@query("baseline_profile_lineitem", f"""
WITH long AS ({S.long_sql('lineitem', LINEITEM_NUM, 'DOUBLE')})
SELECT feature, round(avg(value), 3) + 0.0 AS mean, round(stddev_pop(value), 3) + 0.0 AS std,
       round(quantile_cont(value, 0.5), 3) + 0.0 AS median, round(min(value), 3) + 0.0 AS min,
       round(max(value), 3) + 0.0 AS max
FROM long GROUP BY feature""")
def baseline_profile_lineitem(spark, sf_dir):
    return profile.baseline_profile(table(spark, sf_dir, "lineitem"), LINEITEM)


@query("categorical_profile_orders", f"""
WITH long AS ({S.long_sql('orders', ORDER_CAT, 'VARCHAR')}),
counts AS (SELECT feature, value, count(*) AS c FROM long WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY c DESC, value) AS r,
                  count(*) OVER (PARTITION BY feature) AS d FROM counts)
SELECT feature, value AS top_category, d AS unique_count, 0.0::DOUBLE AS missing_pct
FROM ranked WHERE r = 1""")
def categorical_profile_orders(spark, sf_dir):
    return profile.categorical_profile(table(spark, sf_dir, "orders"), ORDER_FEATURES)


@query("baseline_build_lineitem", f"""
WITH ref_long AS ({S.long_sql('lineitem', LINEITEM_NUM, 'DOUBLE')}),
{S.bins_sql()},{S.BINS_FROM_EDGES},{S.histogram_sql('h', 'ref_long')},
prof AS (SELECT feature, round(avg(value), 3) + 0.0 AS mean, round(stddev_pop(value), 3) + 0.0 AS std,
                round(quantile_cont(value, 0.5), 3) + 0.0 AS median
         FROM ref_long GROUP BY feature),
cats AS ({S.long_sql('lineitem', LINEITEM_CAT, 'VARCHAR')}),
cc AS (SELECT feature, value, count(*) AS c FROM cats GROUP BY ALL),
ct AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n FROM cc)
SELECT feature, 'numerical' AS feature_type, CAST(bin AS INTEGER) AS bin, NULL AS category,
       round(low, 4) + 0.0 AS edge, round(c / n, 5) + 0.0 AS share, mean, std, median
FROM h JOIN prof USING (feature)
UNION ALL
SELECT feature, 'categorical', NULL, value, NULL, round(c / n, 5) + 0.0, NULL, NULL, NULL FROM ct""")
def baseline_build_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    bins, _ = B.build_baseline(df, LINEITEM, ["l_orderkey", "l_linenumber"])
    num = bins.filter("feature_type = 'numerical'").select(
        "feature", "feature_type",
        F.posexplode(F.arrays_zip(
            F.slice("bin_edges", F.lit(1), F.size("bin_edges") - 1).alias("edge"),
            F.col("baseline_percentages").alias("share"))).alias("bin", "_b"),
        "mean", "std", "median",
    ).select(
        "feature", "feature_type", "bin", F.lit(None).cast("string").alias("category"),
        rounded(F.col("_b.edge"), 4).alias("edge"), rounded(F.col("_b.share"), 5).alias("share"),
        "mean", "std", "median",
    )
    cat = bins.filter("feature_type = 'categorical'").select(
        "feature", "feature_type", F.explode("category_percentages").alias("category", "share")
    ).withColumn("share", rounded(F.col("share"), 5))
    return num.unionByName(cat, allowMissingColumns=True)


@query("reference_sample_orders", """
WITH keyed AS (SELECT *, CAST('0x' || substr(md5(o_orderkey || '|42'), 1, 13) AS BIGINT) AS key
               FROM orders),
ranked AS (SELECT *, row_number() OVER (ORDER BY key) AS r FROM keyed)
SELECT o_orderkey, o_custkey, o_totalprice FROM ranked WHERE r <= 10000""")
def reference_sample_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return B.reference_sample(orders, ["o_orderkey"], 10_000)


FEATURE_DRIFT = f"""
WITH {LINEITEM_SIDES_SQL},{PSI_NUM},{S.psi_sum_sql()},
{S.category_ctes('ref', 'cur', LINEITEM_CAT)},{S.psi_cat_sum_sql()},{S.ks_ctes()},{S.CHI2},
num_prof AS (SELECT feature, round(avg(value), 2) + 0.0 AS mean,
               round(stddev_samp(value), 2) + 0.0 AS std,
               round(quantile_cont(value, 0.5), 2) + 0.0 AS median FROM cur_long GROUP BY feature),
base_prof AS (SELECT feature, round(avg(value), 2) + 0.0 AS mean,
               round(stddev_samp(value), 2) + 0.0 AS std,
               round(quantile_cont(value, 0.5), 2) + 0.0 AS median FROM ref_long GROUP BY feature),
cat_mode AS (SELECT feature, category, row_number() OVER (PARTITION BY feature
               ORDER BY cc DESC, category) AS r,
               count(*) FILTER (WHERE cc > 0) OVER (PARTITION BY feature) AS d FROM cells),
meta AS (SELECT * FROM (VALUES ('l_quantity', 'high'), ('l_extendedprice', 'high'),
  ('l_discount', 'medium'), ('l_tax', 'low'), ('l_returnflag', 'high'), ('l_linestatus', 'medium'))
  t(feature, importance)),
both_ AS (
 SELECT p.feature, 'numerical' AS feature_type, p.psi, k.ks_statistic,
        NULL::DOUBLE AS chi2_statistic, n.mean AS current_mean, n.std AS current_std,
        n.median AS current_median, b.mean AS baseline_mean, b.median AS baseline_median,
        NULL AS current_top_category, NULL::BIGINT AS current_unique_count, p.ref_n, p.cur_n
 FROM psi_num p JOIN ks k USING (feature) JOIN num_prof n USING (feature)
 JOIN base_prof b USING (feature)
 UNION ALL
 SELECT p.feature, 'categorical', p.psi, NULL, c.chi2_statistic, NULL, NULL, NULL, NULL, NULL,
        m.category, m.d, p.ref_n, p.cur_n
 FROM psi_cat p JOIN chi2 c USING (feature) JOIN cat_mode m ON m.feature = p.feature AND m.r = 1)
SELECT *, {S.STATUS} AS status FROM both_ JOIN meta USING (feature)"""


@query("feature_drift_lineitem", FEATURE_DRIFT)
def feature_drift_lineitem(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    table_ = drift.feature_drift(ref, cur, LINEITEM, p_values=False)
    return table_.select(
        "feature", "feature_type", "psi", "ks_statistic", "chi2_statistic", "current_mean",
        "current_std", "current_median", "baseline_mean", "baseline_median",
        "current_top_category", "current_unique_count", "ref_n", "cur_n", "status", "importance",
    )


@query("feature_drift_pvalues_lineitem")
def feature_drift_pvalues_lineitem(spark, sf_dir):
    ref, cur = lineitem_sides(spark, sf_dir)
    return drift.feature_drift(ref, cur, LINEITEM, histograms=True).drop("histogram")


SCORED_LINEITEM = """
scored AS (SELECT *, least(1.0::DOUBLE, l_quantity / 55.0::DOUBLE + l_discount) AS prediction_score
           FROM lineitem),
ref AS (SELECT * FROM scored WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00'),
cur AS (SELECT * FROM scored WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00')"""
DECILES_SQL = f"edges AS (SELECT 'prediction_score' AS feature, unnest({S.PROBS}) AS e)"


def scored_lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn(
        "prediction_score", F.least(F.lit(1.0), F.col("l_quantity") / 55.0 + F.col("l_discount"))
    )


@query("prediction_drift_lineitem", f"""
WITH {SCORED_LINEITEM},
{S.psi_numerical_ctes('ref', 'cur', ['prediction_score'], edges=DECILES_SQL)},{S.psi_sum_sql()},
{S.ks_ctes()}
SELECT p.feature, 'numerical' AS feature_type, 'critical' AS importance, p.psi,
       CASE WHEN psi >= 0.15 THEN 'DRIFT' WHEN psi >= 0.10 THEN 'WARNING' ELSE 'STABLE' END AS status,
       ks_statistic, (SELECT round(avg(prediction_score), 4) FROM ref) AS baseline_mean,
       (SELECT round(avg(prediction_score), 4) FROM cur) AS production_mean, p.ref_n, p.cur_n
FROM psi_num p JOIN ks USING (feature)""")
def prediction_drift_lineitem(spark, sf_dir):
    df = scored_lineitem(spark, sf_dir)
    cut = "l_shipdate < TIMESTAMP '1998-01-01 00:00:00'"
    return drift.prediction_drift(df.filter(cut), df.filter(f"NOT {cut}"), p_values=False)


@query("fixed_decile_hist_lineitem", f"""
WITH s AS (SELECT l_quantity / 40.0::DOUBLE + 0.0 AS v FROM lineitem),
b AS (SELECT unnest(range(0, 10)) AS bin, unnest({S.PROBS}[1:10]) AS low, unnest({S.PROBS}[2:11]) AS high)
SELECT CAST(bin AS INTEGER) AS bin, low::DOUBLE AS low, high::DOUBLE AS high,
       count(*) FILTER (WHERE v >= low AND (v < high OR (bin = 9 AND v <= high))) AS "count",
       round(count(*) FILTER (WHERE v >= low AND (v < high OR (bin = 9 AND v <= high))) / count(*), 5)
         + 0.0 AS share, count(*) AS n, round(avg(v), 4) AS mean
FROM s, b GROUP BY bin, low, high""")
def fixed_decile_hist_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_quantity") / 40.0)
    rows = binning.histogram_fixed_deciles(df, "score")
    return rows.withColumn("mean", rounded(F.col("mean"), 4))


@query("segment_drift_events", f"""
WITH {EVENTS_SIDES_SQL},{S.psi_numerical_ctes('ref', 'cur', ['value', 'k'], ['event_type'])},
{S.psi_sum_sql(['event_type'])},
sizes AS (SELECT event_type, count(*) AS sample_count FROM cur GROUP BY event_type)
SELECT event_type, feature, psi, {S.STATUS} AS status, ref_n, cur_n, sample_count,
       max(psi) OVER (PARTITION BY event_type) AS max_psi
FROM psi_num JOIN sizes USING (event_type)""")
def segment_drift_events(spark, sf_dir):
    ref, cur = events_sides(spark, sf_dir)
    return drift.segment_drift(ref, cur, EVENTS[:2], "event_type").select(
        "event_type", "feature", "psi", "status", "ref_n", "cur_n", "sample_count", "max_psi"
    )


# Views are counted as a segment without a name; one declared feature has no column.
NULL_SEGMENT = "CASE WHEN event_type = 'view' THEN NULL ELSE event_type END"


@query("segment_drift_null_events", f"""
WITH {EVENTS_SQL},
ref AS (SELECT * FROM ev WHERE "timestamp" < TIMESTAMP '2024-01-09 00:00:00'),
cur AS (SELECT * EXCLUDE event_type, coalesce({NULL_SEGMENT}, '(none)') AS event_type
        FROM ev WHERE "timestamp" >= TIMESTAMP '2024-01-09 00:00:00'),
{S.psi_numerical_ctes('ref', 'cur', ['value', 'k'], ['event_type'])},
{S.psi_sum_sql(['event_type'])},
sizes AS (SELECT event_type, count(*) AS sample_count FROM cur GROUP BY event_type),
every AS (SELECT event_type, feature, psi, ref_n, cur_n FROM psi_num
          UNION ALL SELECT event_type, 'absent', 0.0, 0, 0 FROM sizes)
SELECT nullif(event_type, '(none)') AS event_type, feature, psi, {S.STATUS} AS status, ref_n, cur_n, sample_count,
       max(psi) OVER (PARTITION BY event_type) AS max_psi
FROM every JOIN sizes USING (event_type)""")
def segment_drift_null_events(spark, sf_dir):
    ref, cur = events_sides(spark, sf_dir)
    cur = cur.withColumn("event_type", F.expr(NULL_SEGMENT))
    return drift.segment_drift(ref, cur, [*EVENTS[:2], Feature("absent")], "event_type").select(
        "event_type", "feature", "psi", "status", "ref_n", "cur_n", "sample_count", "max_psi"
    )


@query("segment_drift_documents", f"""
WITH cur AS (SELECT source, lang, n_chars FROM documents), ref AS (SELECT * FROM cur),
{S.psi_numerical_ctes('ref', 'cur', ['n_chars'], ['source'])},{S.psi_sum_sql(['source'])},
{S.category_ctes('ref', 'cur', ['lang'], ['source'])},{S.psi_cat_sum_sql(['source'])},
sizes AS (SELECT source, count(*) AS sample_count FROM cur GROUP BY source),
psi_all AS (SELECT * FROM psi_num UNION ALL SELECT * FROM psi_cat)
SELECT source, feature, psi, {S.STATUS} AS status, ref_n, cur_n, sample_count,
       max(psi) OVER (PARTITION BY source) AS max_psi
FROM psi_all JOIN sizes USING (source)""")
def segment_drift_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    feats = [Feature("n_chars"), Feature("lang", CATEGORICAL)]
    return drift.segment_drift(docs, docs, feats, "source").select(
        "source", "feature", "psi", "status", "ref_n", "cur_n", "sample_count", "max_psi"
    )


WINDOW_PSI = f"""{EVENTS_SIDES_SQL},
{S.psi_numerical_ctes('ref', 'cur', ['value', 'k'], ['window_start'])},{S.psi_sum_sql(['window_start'])},
{S.category_ctes('ref', 'cur', ['event_type'], ['window_start'])},{S.psi_cat_sum_sql(['window_start'])},
psi_all AS (SELECT * FROM psi_num UNION ALL SELECT * FROM psi_cat)"""


@query("window_drift_events", f"""
WITH {WINDOW_PSI}
SELECT window_start, feature, psi, {S.STATUS} AS status, ref_n, cur_n FROM psi_all""")
def window_drift_events(spark, sf_dir):
    ref, cur = events_sides(spark, sf_dir)
    series = drift.window_drift_series(ref, cur, EVENTS)
    return series.select("window_start", "feature", "psi", "status", "ref_n", "cur_n")
