"""Connected components of links, by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.text import written


def _mark(edges: DataFrame) -> tuple:
    """Count and checksums of an edge table; equal marks mean equal tables."""
    h = F.xxhash64("v", "m")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.bit_xor(h)).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node with a link; the root is the smallest node of the component.

    Large star: a node hands its smallest neighbour to its larger neighbours. Small star: to its smaller ones. Both are
    a grouped minimum joined back to the edges, so a node with very many links is spread like any skewed join. Each step is a
    table in the shared folder; the number of steps grows with the logarithm of the longest path.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).filter("v <> m").distinct(), "links"
    )
    mark = _mark(edges)
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.filter("w > u").join(least, "u").select(F.col("w").alias("v"), "m").filter("v <> m").distinct()
        large = written(large, "large-star")
        least = large.groupBy("v").agg(F.min("m").alias("r"))
        down = large.join(least, "v").filter("m <> r").select(F.col("m").alias("v"), F.col("r").alias("m"))
        edges = written(down.union(least.select("v", F.col("r").alias("m"))).distinct(), "small-star")
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("root")).union(
                edges.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
            )
        mark = now


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after further ``links`` (``a, b``): only links between different components are searched anew."""
    known = roots.select(F.col("node").alias("n"), F.col("root").alias("r"))
    ends = links.join(known, F.col("a") == F.col("n"), "left").select("a", "b", F.coalesce("r", "a").alias("ra"))
    ends = ends.join(known, F.col("b") == F.col("n"), "left").select("a", "b", "ra", F.coalesce("r", "b").alias("rb"))
    ends = written(ends.filter("ra <> rb").select("ra", "rb").distinct(), "links-between")
    moved = components(ends, "ra", "rb").select(F.col("node").alias("r"), F.col("root").alias("s"))
    kept = roots.select("node", F.col("root").alias("r")).join(moved, "r", "left").select("node", F.coalesce("s", "r").alias("root"))
    fresh = moved.select(F.col("r").alias("node"), F.col("s").alias("root")).join(roots.select("node"), "node", "left_anti")
    return kept.union(fresh)
