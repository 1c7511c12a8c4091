"""Near duplicates by MinHash and an LSH forest.

Documents with equal shingle sets are one node. A forest holds the nodes in several sorted orders, one per tree, each by
a label of signature values. A run of nodes that share a label prefix is a region; nodes of a region are candidates, nearest
first by the longest common prefix:

1. Every node meets the most central node of each of its regions at the least depth (the one whose labels are most often their
   region's commonest); the one with the best signature estimate is measured on the full sets. Links give components, so a large
   group of near copies is already one component.
2. In regions that still hold several components, sorted by the whole label, nodes meet their neighbours of other
   components on both sides: those with the longest common prefix. Verified links join the components.
3. Regions that still hold several compare the nodes outside the largest component with all nodes of the region, all at the
   least depth; large regions are dealt in blocks, every two of which meet. A block counts the shingles of all its pairs at once;
   shingles that only one of its nodes has link nothing, and a node of mostly such ones is left out.

Pairs whose signatures agree far too little for the wanted similarity are dropped before sets are read; all others are verified on
the full sets, and components of the verified links are the groups.

Defined cases: NULL, empty and blank texts have no shingles and stay alone; a text with fewer words than a shingle is one shingle;
rows with equal ids are rows of their own; a NULL id never names a group while another id is in it; an empty table gives no
rows; input columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.components import components, extended
from siltmark.llm.shared_keys import picked, row_id
from siltmark.llm.shingles import MinHasher, WordHashes, digest, shingle_hashes, words_of
from siltmark.llm.text import written

TREES = 16
DEPTH = 8
LEAST_DEPTH = 4
#: Signature agreement below ``similarity - MARGIN`` (five standard deviations) is no candidate.
MARGIN = 0.18
#: Pairs of nodes in a block of a region; a region of any size is compared wholly.
REGION_WORK = 1 << 20
#: Shingles that one side of a block holds, about; a region with more is dealt in more blocks.
BLOCK_SHINGLES = 1 << 22
#: Columns of a dense part of a block's product, and pairs of one step of its sparse part.
DENSE_COLUMNS, SPARSE_PAIRS = 4096, 1 << 22
#: Most nodes whose ids are broadcast to read their texts; beyond that the texts are joined by shuffle.
BROADCAST_NODES = 1_000_000


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str, trees: int, depth: int) -> DataFrame:
    """``uid, doc_id, n_shingles, node, sig, sketch``: size, digest and signature of every document's shingle set; the
    sketch holds the lowest byte of each signature value, eight in a long."""

    @F.pandas_udf("n_shingles long, node binary, sig binary, sketch array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo, minhash = WordHashes(), MinHasher(trees * depth)
        for texts in batches:
            sizes, nodes, sigs, sketches = [], [], [], []
            for text in texts:
                values = np.unique(shingle_hashes(words_of(text), memo, width))
                sizes.append(values.size)
                nodes.append(digest(values))
                sig = minhash(values)
                sigs.append(sig.tobytes() if values.size else b"")
                sketches.append(sig.astype(np.uint8).view(np.int64))
            yield pd.DataFrame({"n_shingles": sizes, "node": nodes, "sig": sigs, "sketch": sketches})

    return docs.select(
        row_id(id_col, F.col(text_col)).alias("uid"), F.col(id_col).alias("doc_id"), sign(F.col(text_col)).alias("_s")
    ).select("uid", "doc_id", "_s.*")


def region_key(tree: int, depth: int, whole: int) -> Column:
    """A label prefix of one tree as a hash; equal prefixes of one tree are neighbours in its sorted order."""
    return F.xxhash64(F.lit(tree * 64 + depth), F.substring("sig", 1 + tree * whole * 4, depth * 4))


def agreement(a: str, b: str, values: int) -> Column:
    """Share of equal bytes of two sketch columns: the bits of each byte of the XOR are folded into its lowest one."""
    differ = F.lit(0)
    for k in range(values // 8):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(mask)
        differ = differ + F.bit_count(x)
    return 1 - differ / F.lit(float(values))


def with_ids_of(docs: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is among ``wanted``'s column ``id``: broadcast after a count, else by shuffle."""
    ids = wanted.select("id").distinct()
    if wanted.count() <= BROADCAST_NODES:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("id")), "left_semi")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``node, shingles`` of the wanted nodes (``node, id``), from the whole texts."""

    @F.pandas_udf("node binary, shingles array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for texts in batches:
            found = [np.unique(shingle_hashes(words_of(t), memo, width)) for t in texts]
            yield pd.DataFrame({"node": [digest(v) for v in found], "shingles": [v.view(np.int64) for v in found]})

    # Marked as not deterministic: else Spark puts a filter on its result, and with it the function, below the join that picks the rows.
    made = sets.asNondeterministic()
    rows = with_ids_of(docs.select(id_col, text_col), wanted, id_col)
    found = rows.select(F.col(id_col).alias("id"), made(F.col(text_col)).alias("_s")).select("id", "_s.*")
    same = wanted.select(F.col("node"), F.col("id"))
    return found.dropDuplicates(["node", "id"]).join(same, (found["node"] == same["node"]) & found["id"].eqNullSafe(same["id"]), "left_semi").select("node", "shingles")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, shared, united``: sizes of intersection and union of the full sets."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("united"))


def linked(sizes: DataFrame, percent: int) -> DataFrame:
    return sizes.filter(F.col("shared") * 100 >= F.col("united") * percent).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` with 100 * intersection >= percent * union, counted on the full sets."""
    return linked(measured(pairs, sets), percent)


def estimated(pairs: DataFrame, nodes: DataFrame, least: float, values: int) -> DataFrame:
    """``a, b, estimate`` for the pairs whose signatures agree enough."""
    sig = nodes.select("node", "sketch")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(
        sig.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b"
    )
    return both.select("a", "b", agreement("sa", "sb", values).alias("estimate")).filter(F.col("estimate") >= least)


def label_of(whole: int) -> Column:
    return F.substring(F.col("sig"), F.col("tree") * (whole * 4) + 1, F.lit(whole * 4))


def first_round(members: DataFrame, whole: int) -> DataFrame:
    """``a, b``: every node with the most central node of each of its regions."""
    labels = members.select("region", "node", label_of(whole).alias("label"))
    common = labels.groupBy("region", "label").agg(F.count("*").alias("n")).groupBy("region").agg(
        F.max(F.struct("n", "label")).alias("top")
    ).filter("top.n > 1").select("region", F.col("top.label").alias("label"))
    central = labels.join(common, ["region", "label"], "left_semi").groupBy("node").agg(F.count("*").alias("central"))
    ranked = members.select("region", "node").join(central, "node", "left").withColumn("central", F.coalesce("central", F.lit(0).cast("long")))
    heads = ranked.groupBy("region").agg(F.max(F.struct("central", "node")).alias("top")).select("region", F.col("top.node").alias("b"))
    return members.join(heads, "region").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()


def mixed_regions(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of regions with several components, with their ``root``, the region's largest component ``main``, its size
    ``m`` and ``s``, the nodes outside ``main``; ``m_shingles`` and ``s_shingles`` are the shingles of those nodes."""
    rows = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = rows.groupBy("region", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("z"))
    summed = per_root.groupBy("region").agg(
        F.sum("n").alias("m"), F.sum("z").alias("m_shingles"), F.max(F.struct("n", "root", "z")).alias("top")
    )
    several = summed.select(
        "region", "m", F.col("top.root").alias("main"), (F.col("m") - F.col("top.n")).alias("s"),
        "m_shingles", (F.col("m_shingles") - F.col("top.z")).alias("s_shingles"),
    ).filter("s > 0")
    return rows.join(several, "region")


def neighbours(members: DataFrame, roots: DataFrame, whole: int) -> DataFrame:
    """``a, b`` of different components that are neighbours in a tree's sorted order, or next to each other but for nodes
    outside the region's largest component."""
    rows = mixed_regions(members, roots).withColumn("label", label_of(whole)).select("region", "label", "node", "root", "main")
    up = Window.partitionBy("region").orderBy("label", "node").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("region").orderBy(F.desc("label"), F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    placed = F.struct("node", "root")
    large = F.when(F.col("root") == F.col("main"), placed)
    for name, order in (("up", up), ("down", down)):
        rows = rows.withColumn(f"{name}_any", F.last(placed).over(order)).withColumn(f"{name}_main", F.last(large, ignorenulls=True).over(order))
    near = F.array("up_any", "up_main", "down_any", "down_main")
    pairs = rows.select("node", "root", F.explode(near).alias("o")).filter("o IS NOT NULL AND o.root <> root")
    return pairs.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()


def shared_counts(owner: np.ndarray, values: np.ndarray, left: np.ndarray, right: np.ndarray, needed: np.ndarray):
    """``left, right, counts``: the values that nodes ``left`` and ``right`` have in common, one count for each pair.

    ``owner`` has the node of each of ``values`` (distinct within a node). Nodes that share fewer than ``needed`` values with
    any others are left out. Values that many pairs share are counted by a dense product, the others pair by pair.
    """
    order = np.argsort(values, kind="stable")
    owner, run = owner[order], np.cumsum(np.diff(values[order], prepend=values[order[:1]]) != 0)
    common = np.bincount(run)[run] > 1
    owner, run = owner[common], run[common]
    alive = np.bincount(owner, minlength=needed.size) >= needed
    left, right = left[alive[left]], right[alive[right]]
    counts = np.zeros((left.size, right.size))
    if not counts.size:
        return left, right, counts
    at = np.full((2, needed.size), -1)
    at[0, left], at[1, right] = np.arange(left.size), np.arange(right.size)
    size = int(run.max(initial=-1)) + 1
    held = [(at[k, owner[m]], run[m]) for k in (0, 1) for m in [at[k, owner] >= 0]]
    n_left, n_right = (np.bincount(r, minlength=size) for _, r in held)
    work = n_left * n_right
    dense = np.flatnonzero(work * 64 > counts.size)
    for first in range(0, dense.size, DENSE_COLUMNS):
        part = dense[first : first + DENSE_COLUMNS]
        column = np.full(size, -1)
        column[part] = np.arange(part.size)
        a, b = (np.zeros((n, part.size), np.float32) for n in counts.shape)
        for side, (row, r) in zip((a, b), held):
            here = column[r] >= 0
            side[row[here], column[r[here]]] = 1
        counts += a @ b.T
    work[dense] = 0
    (row, r), (other, s) = held
    row, r = row[work[r] > 0], r[work[r] > 0]
    start = np.searchsorted(s, np.arange(size))
    ends = np.cumsum(n_right[r])
    first = 0
    while first < r.size:
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SPARSE_PAIRS, "right")))
        many = n_right[r[first:last]]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[r[first:last]], many)
        counts += np.bincount(np.repeat(row[first:last], many) * right.size + other[place], minlength=counts.size).reshape(counts.shape)
        first = last
    return left, right, counts


def block_links(node, root, sketch, sizes, values, is_left, is_right, percent: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the left and the right nodes of a block that are of different components."""
    _, first, same = np.unique(node, return_index=True, return_inverse=True)
    left, right = np.unique(same[is_left]), np.unique(same[is_right])
    starts = np.cumsum(sizes) - sizes
    kept = np.zeros(node.size, bool)
    kept[first] = True
    owner, values = np.repeat(same, sizes), values if kept.all() else values[np.repeat(kept, sizes)]
    owner = owner if kept.all() else owner[np.repeat(kept, sizes)]
    root, sketch, sizes, node = root[first], sketch[first], sizes[first], node[first]
    left, right, shared = shared_counts(owner, values, left, right, -(-sizes * percent // 100))
    close = shared * (100 + percent) >= (sizes[left][:, None] + sizes[right][None]) * percent
    a, b = np.nonzero(close & (root[left][:, None] != root[right][None]))
    a, b = left[a], right[b]
    differ = (sketch[a] != sketch[b]).sum(1)
    good = 1 - differ / float(sketch.shape[1]) >= least
    return node[a[good]], node[b[good]]


def later_links(
    members: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, least: float, values: int,
) -> DataFrame:
    """``a, b``: links between components in regions that hold several.

    Nodes outside a region's largest component meet all its nodes, in blocks of about ``REGION_WORK`` pairs, each in the memory
    of a task; only links leave it.
    """
    side = max(1, math.isqrt(REGION_WORK))
    placed = written(mixed_regions(members, roots), "regions")

    def parts(count: str, shingles: str) -> Column:
        return F.greatest(F.ceil(F.col(count) / side), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")

    data = nodes.select("node", "sketch").join(sets, "node")
    here = placed.withColumns({"lefts": parts("s", "s_shingles"), "rights": parts("m", "m_shingles")}).withColumns(
        {"outside": F.col("root") != F.col("main"), "whole": (F.col("lefts") == 1) & (F.col("rights") == 1), "dealt": F.xxhash64("node", "region")}
    ).select("region", "node", "root", "lefts", "rights", "outside", "whole", "dealt")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    # Nodes of a region of one block are on both sides of it in one row.
    left = here.filter("outside AND NOT whole").withColumn("lb", F.pmod("dealt", "lefts").cast("int")).withColumn("rb", every("rights"))
    right = here.withColumn("rb", F.pmod("dealt", "rights").cast("int")).withColumn("lb", every("lefts"))
    left = left.withColumns({"is_left": F.lit(True), "is_right": F.lit(False)})
    right = right.withColumns({"is_left": F.col("outside") & F.col("whole"), "is_right": F.lit(True)})
    columns = ("region", "lb", "rb", "node", "root", "is_left", "is_right")
    rows = left.select(*columns).unionByName(right.select(*columns)).join(data, "node")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def found() -> pa.RecordBatch:
            a, b = block_links(*[np.concatenate(x) for x in zip(*held)], percent, least)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.tolist(), pa.binary()), "b": pa.array(b.tolist(), pa.binary())})

        def digests(column: pa.Array) -> np.ndarray:
            return np.array(column.to_pylist(), "V16")

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy() for k in ("region", "lb", "rb")])
            sizes = batch.column("shingles").value_lengths().to_numpy().astype(np.int64)
            shingles, ends = batch.column("shingles").flatten().to_numpy(), np.cumsum(sizes)
            sketch = np.ascontiguousarray(batch.column("sketch").flatten().to_numpy()).view(np.uint8).reshape(-1, values)
            node, root = digests(batch.column("node")), digests(batch.column("root"))
            flags = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("is_left", "is_right")]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                if held and (keys[x] != key).any():
                    yield found()
                    held = []
                key = keys[x]
                inner = shingles[ends[x] - sizes[x] : ends[y - 1]]
                held.append((node[x:y], root[x:y], sketch[x:y], sizes[x:y], inner, *[f[x:y] for f in flags]))
        if held:
            yield found()

    dealt = rows.repartition("region", "lb", "rb").sortWithinPartitions("region", "lb", "rb")
    pairs = written(dealt.mapInArrow(links, "a binary, b binary"), "later-links")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    trees: int = TREES, depth: int = DEPTH, least_depth: int = LEAST_DEPTH,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, uid`` for every row; ``kept`` where the document names its group."""
    rows = written(signatures(docs, width, id_col, text_col, trees, depth), "signatures")
    nodes = written(
        rows.filter("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")
        ), "nodes"
    )
    labelled = nodes.select("node", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tree"), region_key(t, least_depth, depth).alias("region")) for t in range(trees)
    ])).alias("_r")).select("node", "_r.*")
    shared = labelled.groupBy("region").agg(F.count("*").alias("m")).filter("m > 1").select("region")
    members = written(labelled.join(shared, "region").join(nodes.select("node", "sig", "n_shingles"), "node"), "members")

    least = percent / 100 - MARGIN
    best = F.max(F.struct("estimate", "b")).alias("top")
    first = written(
        estimated(first_round(members, depth), nodes, least, trees * depth).groupBy("a").agg(best).select("a", F.col("top.b").alias("b")), "first-pairs"
    )
    wanted = written(nodes.select("node", "id").join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = written(shingle_sets(docs, wanted, width, id_col, text_col), "sets")
    roots = written(components(verified(first, sets, percent)), "roots")

    near = written(estimated(neighbours(members, roots, depth), nodes, least, trees * depth).select("a", "b"), "neighbours")
    roots = written(extended(roots, verified(near, sets, percent)), "roots")

    later = later_links(members, roots, nodes, sets, percent, least, trees * depth)
    roots = written(extended(roots, later), "roots")

    placed = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    groups = placed.join(named, "root").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node", "uid").join(groups, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "uid").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    ).select("doc_id", "n_shingles", "component_id", "kept", "uid")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: of the rows that name the group, the one with the smallest row number.

    Rows are dropped by an anti-join with what goes, so texts that stay move only if that table is too large to broadcast.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    verdicts = written(near_duplicates(docs.select(id_col, text_col), **options), "verdicts")
    group = F.when((F.col("n_shingles") > 0) & F.col("component_id").isNotNull(), F.struct("component_id")).otherwise(F.lit(None))
    grouped = verdicts.withColumn("_g", group)
    stay = grouped.filter("kept AND _g IS NOT NULL").groupBy("_g").agg(F.min("uid").alias("_stay"))
    gone = grouped.filter("_g IS NOT NULL").join(stay, "_g").filter("uid <> _stay").select("uid").distinct()
    rows = docs.withColumn("_uid", row_id(id_col, F.col(text_col)))
    left = picked(rows.withColumnRenamed("_uid", "uid") if "uid" not in docs.columns else rows.drop("uid").withColumnRenamed("_uid", "uid"), written(gone, "dropped"), "left_anti")
    repeated = verdicts.groupBy("uid").agg(F.count("*").alias("n"), F.max("n_shingles").alias("s")).filter("n > 1 AND s > 0")
    repeated = written(repeated.select("uid"), "repeated-rows")
    if repeated.count():  # rows equal in id and text: one of them
        left = picked(left, repeated, "left_anti").unionByName(picked(left, repeated, "left_semi").dropDuplicates(["uid"]))
    return left.select(*[c for c in docs.columns if c != "uid"])
