"""How the driver tables are read as monitoring inputs.

Every split covers its whole table: each row is on exactly one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.config import CATEGORICAL, Feature
from siltmark.plans.registry import table

LINEITEM = (
    Feature("l_quantity", importance="high", min=1, max=50),
    Feature("l_extendedprice", importance="high", min=900, max=100000),
    Feature("l_discount", importance="medium", min=0.0, max=0.1),
    Feature("l_tax", importance="low", min=0.0, max=0.08),
    Feature("l_returnflag", CATEGORICAL, "high", allowed_values=("A", "N", "R")),
    Feature("l_linestatus", CATEGORICAL, "medium", allowed_values=("F", "O")),
)
LINEITEM_NUM = [f.name for f in LINEITEM if f.is_numerical]
LINEITEM_CAT = [f.name for f in LINEITEM if not f.is_numerical]

EVENTS = (
    Feature("value", importance="high", min=0.5, max=400.0),
    Feature("k", importance="medium", min=0, max=95),
    Feature("event_type", CATEGORICAL, "high", allowed_values=("click", "view", "purchase")),
)

# Older shipments are the baseline; the current side ships later or in bulk.
LINEITEM_CURRENT = "(l_shipdate >= TIMESTAMP '2000-01-01 00:00:00' OR l_quantity > 38)"
ORDERS_CURRENT = "(o_orderdate >= TIMESTAMP '1999-01-01 00:00:00')"
EVENTS_CURRENT = "(ts >= TIMESTAMP '2024-01-09 00:00:00')"


def lineitem_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "lineitem")
    return df.filter(f"NOT {LINEITEM_CURRENT}"), df.filter(LINEITEM_CURRENT)


LINEITEM_SIDES_SQL = f"""
ref AS (SELECT * FROM lineitem WHERE NOT {LINEITEM_CURRENT}),
cur AS (SELECT * FROM lineitem WHERE {LINEITEM_CURRENT})"""


def orders_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "orders")
    return df.filter(f"NOT {ORDERS_CURRENT}"), df.filter(ORDERS_CURRENT)


ORDERS_SIDES_SQL = f"""
ref AS (SELECT * FROM orders WHERE NOT {ORDERS_CURRENT}),
cur AS (SELECT * FROM orders WHERE {ORDERS_CURRENT})"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an inference log: most ``value`` cells of the small hours are missing,
    ``k`` is the number inside ``props`` as text."""
    return log_columns(table(spark, sf_dir, "events"))


def log_columns(e: DataFrame) -> DataFrame:
    return e.withColumns({
        "timestamp": F.col("ts").cast("timestamp"),
        "value": F.when(
            (F.hour(F.col("ts").cast("timestamp")) >= 3) | (F.col("value") < 20), F.col("value")
        ),
        "k": F.get_json_object("props", "$.k"),
        "prediction_score": F.least(F.lit(1.0), F.col("value") / 120.0),
    }).select("event_id", "timestamp", "user_id", "event_type", "value", "k", "prediction_score")


EVENTS_SQL = """
ev AS (SELECT event_id, ts AS "timestamp", user_id, event_type,
              CASE WHEN hour(ts) >= 3 OR value < 20 THEN value END AS value,
              json_extract_string(props, '$.k') AS k,
              least(1.0::DOUBLE, value / 120.0::DOUBLE) AS prediction_score
       FROM events)"""


def events_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = events(spark, sf_dir)
    cut = F.lit("2024-01-09 00:00:00").cast("timestamp")
    return df.filter(F.col("timestamp") < cut), df.filter(F.col("timestamp") >= cut)


EVENTS_SIDES_SQL = EVENTS_SQL + """,
ref AS (SELECT * FROM ev WHERE "timestamp" < TIMESTAMP '2024-01-09 00:00:00'),
cur AS (SELECT *, time_bucket(INTERVAL 6 HOUR, "timestamp", TIMESTAMP '1970-01-01') AS window_start,
               date_trunc('day', "timestamp") AS day
        FROM ev WHERE "timestamp" >= TIMESTAMP '2024-01-09 00:00:00')"""
