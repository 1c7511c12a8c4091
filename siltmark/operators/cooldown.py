"""Replay of cooldowns over a whole alert history, without an ordered walk through a key.

Whether a candidate is delivered depends on the one delivered before it, which looks like a walk through the history. It is a
linked list instead: the moment after a delivery is known from the row alone (the first moment of the key at or after the
end of its cooldown). Delivered moments are those that the key's first moment reaches over these links, and pointer doubling
marks them in as many rounds as the longest chain has binary digits.

1. Rows of one key and moment become one node: the row that starts a cooldown, and when that ends.
2. Links are an as-of join. Moments and ends are sorted together by range, so one key's history is cut into ranges of
   about equal size; the next moment is looked up in the range, or it is the first of the key's next range.
3. Each round marks what marked nodes point at, then lets every pointer skip as far again.

Every step joins or groups on key and moment, so a key of any length is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltmark.sources.workspace import stored

KEY, AT = "_key", "_at"


def _tie(df: DataFrame) -> Column:
    """Order of rows of one key and moment: report order, then anything that tells them apart."""
    names = [c for c in ("position", "run_id", "feature_name") if c in df.columns]
    return F.struct(*names, "cooldown_hours", F.xxhash64(*[F.col(c).cast("string") for c in df.columns]))


def _numbered(candidates: DataFrame) -> DataFrame:
    """``candidates`` with key, moment and a unique place among the rows of that moment; equal rows are numbered."""
    rows = candidates.withColumns({
        KEY: F.struct("dedup_key"), AT: F.col("candidate_at").cast("timestamp"), "_tie": _tie(candidates),
    })
    copy = F.row_number().over(W.partitionBy(KEY, AT, "_tie").orderBy(F.lit(0)))
    return rows.withColumn("_place", F.struct("_tie", copy.alias("copy"))).drop("_tie")


def moments(numbered: DataFrame) -> DataFrame:
    """``key, at, until, cut``: per key and moment the first place that starts a cooldown and its end, both NULL if none does."""
    hours = F.coalesce(F.col("cooldown_hours"), F.lit(0))
    starts = F.when(hours > 0, F.struct("_place", hours.alias("hours")))
    return numbered.filter(F.col(AT).isNotNull()).groupBy(KEY, AT).agg(F.min(starts).alias("_s")).select(
        KEY, AT, (F.col(AT) + F.make_interval(secs=(F.col("_s.hours") * 3600).cast("decimal(18,6)"))).alias("until"), F.col("_s._place").alias("cut"),
    )


def successors(nodes: DataFrame) -> DataFrame:
    """``key, at, jump``: the first moment of the key at or after ``until``, or after ``at`` where ``until`` is NULL."""
    # At one time: ends first, then the moment itself, then those that need a later one.
    point = nodes.select(KEY, F.col(AT).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp").alias(AT))
    asks = nodes.select(
        KEY, F.coalesce("until", AT).alias("t"), F.when(F.col("until").isNull(), 2).otherwise(0).alias("kind"), F.col(AT),
    )
    events = point.unionByName(asks).repartitionByRange(KEY, "t", "kind").withColumn("_range", F.spark_partition_id())
    events = stored(events, "cooldown-events")
    is_point = F.when(F.col("kind") == 1, F.col("t"))
    later = W.partitionBy("_range", KEY).orderBy(F.desc("t"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    near = events.withColumn("_near", F.last(is_point, ignorenulls=True).over(later)).filter("kind <> 1")
    after = W.partitionBy(KEY).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    ranges = events.groupBy(KEY, "_range").agg(F.min(is_point).alias("_first")).withColumn(
        "_far", F.last("_first", ignorenulls=True).over(after)
    )
    return near.join(ranges.select(KEY, "_range", "_far"), [KEY, "_range"]).select(KEY, AT, F.coalesce("_near", "_far").alias("jump"))


def reached(links: DataFrame) -> DataFrame:
    """``key, at`` of the moments that the first one of each key reaches over ``jump``."""
    first = links.groupBy(KEY).agg(F.min(AT).alias(AT)).withColumn("marked", F.lit(True))
    state = stored(
        links.join(first, [KEY, AT], "left").select(KEY, AT, "jump", F.coalesce("marked", F.lit(False)).alias("marked")), "cooldown"
    )
    while not state.filter("marked AND jump IS NOT NULL").isEmpty():
        target = state.select(KEY, F.col(AT).alias("jump"), F.col("jump").alias("further"))
        hit = state.filter("marked AND jump IS NOT NULL").select(KEY, F.col("jump").alias(AT)).distinct().withColumn("hit", F.lit(True))
        state = stored(
            state.join(target, [KEY, "jump"], "left").join(hit, [KEY, AT], "left").select(
                KEY, AT, F.col("further").alias("jump"), (F.col("marked") | F.col("hit").isNotNull()).alias("marked")
            ),
            "cooldown",
        )
    return state.filter("marked").select(KEY, AT)


def cooldown_replay(candidates: DataFrame) -> DataFrame:
    """Replay a history: deliver, stay silent until the cooldown ends, deliver again.

    Adds ``delivered``. Of rows with one key and moment those up to the first with a cooldown are delivered. A NULL or
    non-positive cooldown covers nothing; a row without a time is never delivered; NULL is a key; of equal rows
    one is delivered if it has a cooldown, else all are.
    """
    columns = [c for c in candidates.columns if c != "delivered"]
    numbered = stored(_numbered(candidates.select(*columns)), "cooldown-rows")
    nodes = stored(moments(numbered), "cooldown-moments")
    sent = reached(successors(nodes)).join(nodes.select(KEY, AT, "cut"), [KEY, AT]).withColumn("_sent", F.lit(True))
    up_to = F.col("cut").isNull() | (F.col("_place") <= F.col("cut"))
    return numbered.join(sent, [KEY, AT], "left").select(*columns, F.coalesce(F.col("_sent") & up_to, F.lit(False)).alias("delivered"))
