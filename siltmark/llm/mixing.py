"""Mix sources to target weights by repetition rates.

Tokens (words) are summed per source, targets follow the weights up to a largest repetition,
and a document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction of the rate. DataFrame functions only.

Defined cases: a NULL source is a source of its own and comes last; a NULL or blank text has
size 0 and takes nothing; repeated rows count as often as they occur and make the same draw;
a source without words has target 0; an empty table gives no rows. Columns of the input that
have the name of an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.text import unit_hash, word_count, written

SEED = 17


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, size`` rows per document -> one row per source with its size and target.

    Targets are ``min(most * size, level * weight)`` with the one level that spends
    ``share`` of all sizes: what a full source leaves goes to the others by weight. Sources are
    filled in the order of ``most * size / weight``, so running sums over the source table (a row
    per source, however many documents there are) give the level without a loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill_at", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = F.array(*[F.lit(float(x)) for x in weights])
    stats = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget_left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("budget_left") / F.col("weight_left"))
        .withColumn("open", F.col("fill_at") > F.col("level"))
        .withColumn("final_level", F.min(F.when(F.col("open"), F.struct("fill_at", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("open"), F.least("cap", F.col("weight") * F.col("final_level"))).otherwise(F.col("cap"))
    return stats.select("source", "source_size", target.alias("target"))


def copies(rate: Column, draw: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def mixing_plan(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``.

    The source table is written first; Spark broadcasts it where its known size is below the
    broadcast threshold and joins by shuffle beyond that.
    """
    made = {"size", "source_size", "target", "copies", "taken"}
    keep = [c for c in docs.columns if c not in made]
    sized = docs.select(*keep, word_count(F.col(text_col)).alias("size"))
    targets = written(
        source_targets(sized.select(F.col(source_col).alias("source"), "size"), weights, share, most),
        "source-targets",
    ).withColumnRenamed("source", "_mix_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    draw = unit_hash(F.col(id_col), seed=seed)
    return (
        sized.join(targets, F.col(source_col).eqNullSafe(F.col("_mix_source")))
        .withColumn("copies", copies(F.coalesce(rate, F.lit(0.0)), draw))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*keep, "size", "source_size", "target", "copies", "taken")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the plan says, with the columns of ``docs``."""
    made = {"size", "source_size", "target", "copies", "taken"}
    clash = [c for c in docs.columns if c in made]
    inner = docs.select(*docs.columns, *[F.col(c).alias(f"_kept_{c}") for c in clash])
    plan = mixing_plan(inner, **options).filter("copies > 0")
    repeated = plan.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"_kept_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns])
