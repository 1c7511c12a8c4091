"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a row goes to the owner of the next point clockwise of
its key's hash, and where that shard is full it continues clockwise to the next shard with room.
Only row counts per ring point (a number fixed by the ring, not by the data) are looked at
together; rows are ranked within their ring point and find their shard and slot by that rank.

Defined cases: NULL ids are hashed like a value of their own together with the text's checksum, a
NULL text has size 8 and checksum 0, repeated rows are rows of their own, an empty table gives no
rows, other columns are ignored. Rows equal in id, size and checksum are interchangeable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.text import utf8_bytes

SLOTS = 1 << 14
POINTS = 64


def ring(shards: int, points: int = POINTS, slots: int = SLOTS) -> list[tuple[int, int]]:
    """``(slot, shard)`` of every virtual node, in ring order; a taken slot passes to the next free one."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for point in range(points):
            digest = hashlib.blake2b(f"{shard}/{point}".encode(), digest_size=8).digest()
            slot = int.from_bytes(digest, "big") % slots
            while slot in taken:
                slot = (slot + 1) % slots
            taken[slot] = shard
    return sorted(taken.items())


def _nodes_by_slot(nodes: list[tuple[int, int]], slots: int) -> list[tuple[int, int]]:
    """Ring slot -> index of the next node clockwise."""
    out, node = [], 0
    for slot in range(slots):
        while node < len(nodes) and nodes[node][0] < slot:
            node += 1
        out.append((slot, node % len(nodes)))
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Without slack the bounds add up to the rows, so all shards end full and counts differ by one at most."""
    if slack > 0:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flows(counts: dict[int, int], nodes: list[tuple[int, int]], bounds: list[int]) -> Iterable[tuple[int, int, int, int, int]]:
    """``(node, first rank, end rank, shard, first slot)``: which ranks of a node stay and where the rest goes.

    Rounds: in round r each node offers what is left of its rows to the r-th distinct shard
    clockwise, nodes in ring order.
    """
    room, used = list(bounds), [0] * len(bounds)
    owners = [shard for _, shard in nodes]
    walk = {node: list(dict.fromkeys(owners[node:] + owners[:node])) for node in counts}
    left = {node: 0 for node in sorted(counts)}
    for turn in range(len(bounds)):
        for node in list(left):
            shard = walk[node][turn]
            start = left[node]
            take = min(room[shard], counts[node] - start)
            if take > 0:
                yield node, start, start + take, shard, used[shard]
                room[shard] -= take
                used[shard] += take
                left[node] = start + take
            if left[node] == counts[node]:
                del left[node]


def assign_shards(
    docs: DataFrame, shards: int = 24, points: int = POINTS, slack: float = 0.0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for every row; slots of a shard count from 0 without gaps.

    ``slack`` lets shards exceed their even part by that share, which moves fewer rows when the
    number of shards changes; 0 makes the counts equal within one.
    """
    spark = docs.sparkSession
    nodes = ring(shards, points)
    slots = F.broadcast(spark.createDataFrame(_nodes_by_slot(nodes, SLOTS), "_slot int, _node int"))
    rows = docs.select(
        F.col(id_col),
        (utf8_bytes(F.col(text_col)) + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    key = F.xxhash64(
        F.col(id_col).cast("string"), F.when(F.col(id_col).isNull(), F.col("text_crc32"))
    )
    hashed = (
        rows.withColumn("_hash", key)
        .withColumn("_slot", F.pmod(F.col("_hash"), F.lit(SLOTS)).cast("int"))
        .join(slots, "_slot")
    )
    counts = {r[0]: r[1] for r in hashed.groupBy("_node").count().collect()}  # one row per ring point
    bounds = capacities(sum(counts.values()), shards, slack)
    pieces = spark.createDataFrame(
        list(flows(counts, nodes, bounds)), "_to_node int, _from long, _end long, shard int, _first long"
    )
    order = Window.partitionBy("_node").orderBy("_hash", id_col, "text_crc32", "size")
    ranked = hashed.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    found = ranked.join(
        F.broadcast(pieces),
        (F.col("_node") == F.col("_to_node")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_end")),
    )
    slot = F.col("_first") + F.col("_rank") - F.col("_from")
    return found.select(id_col, "size", "text_crc32", "shard", slot.alias("slot"))
