"""Which keys of a document occur anywhere else, and joins that read few texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.text import written

#: Most ids that are broadcast to pick their texts; beyond that the join shuffles.
BROADCAST_IDS = 1_000_000


def row_id(id_col: Column, text: Column) -> Column:
    """One number for a document: its id and text. Rows equal in both are one document."""
    return F.xxhash64(F.col(id_col) if isinstance(id_col, str) else id_col, F.md5(F.coalesce(text, F.lit(""))))


def picked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined with the written table ``ids`` (column ``uid``), broadcast after a count."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "uid", how)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """``uid, keys[, counts]`` (arrays, keys distinct) -> ``uid, shared``: the keys that occur at least twice over all documents.

    Occurrences are summed map-side first, so a key that every document has costs a row per task.
    """
    item = F.arrays_zip("keys", "counts") if "counts" in keyed.columns else F.transform("keys", lambda k: F.struct(k.alias("keys"), F.lit(1).alias("counts")))
    rows = keyed.select("uid", F.explode(item).alias("k")).select("uid", F.col("k.keys").alias("key"), F.col("k.counts").alias("n"))
    often = rows.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    return rows.select("uid", "key").join(often, "key").groupBy("uid").agg(F.collect_list("key").alias("shared"))


def split_copies(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``uid``, and the table of uids whose whole text stands in a document of smaller id."""
    rows = docs.select(F.col(id_col).alias("_id"), row_id(id_col, F.col(text_col)).alias("uid"), F.md5(F.col(text_col)).alias("_m"))
    first = rows.groupBy("_m").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    copies = rows.join(first, "_m").filter(~F.col("_id").eqNullSafe(F.col("_first"))).select("uid").distinct()
    return docs.withColumn("uid", row_id(id_col, F.col(text_col))), written(copies, "copies")
