"""Exact top-k inner products by best-first search in an M-tree.

Routing objects come from a bounded sample of vectors; every vector is indexed below its nearest one. Sorted by routing
object and distance to it, runs of vectors become pages (metric nodes), runs of pages become subtrees, one row each. A
page holds its entries, their distances to the page's routing object (parent distances) and its covering radius.

With q the query, p the routing object and x an entry, <q,x> = <q,p> + <q,x-p> <= <q,p> + |q| d(x,p): with the covering
radius in place of d this bounds a page, with the stored parent distance an entry, without computing its distance. Pages are
visited by falling bound until the bound is under the k-th best score. A query's own subtree gives the first threshold;
only then do query blocks meet the other subtrees: blocks and subtrees are dealt into the rows and columns of a grid, a task
takes a cell, so tasks grow with cells of fixed size and not with pairs of blocks and subtrees. What a query's own subtree has
beaten, by score and then id, leaves no cell.

Defined cases: vectors that are NULL or hold NULL or non-finite components, and rows without id, take no part; vectors of
different lengths are compared over zero-padded components, an empty vector scores 0; a row is never a candidate of a query with
the same id, repeated rows of a query id and vector are one query; ties go to the smaller id; scores beyond the long range are
clipped to it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.text import unit_hash, written

ROUTES = 64
PAGE = 128
SUBTREE = 16 * PAGE
#: Subtrees of a cell of the grid; it has the queries of 16 times as many.
CELL = 128
#: Pages that are read together.
STEP = 64
#: Below these bounds sums of products are exact in double and in single precision.
EXACT, EXACT_SINGLE = float(1 << 52), float(1 << 24)
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

VECTOR = "id long, vec binary"
TREE = "subtree long, ids binary, vecs binary, width int, starts binary, centers binary, parent binary, radius binary"
BLOCK = "block long, query_ids binary, queries binary, width int, floors binary, floor_ids binary, best_ids binary, best_scores binary"
HITS = "query_id long, query_key long, vec_id long, score long"


def pack(rows: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, the type's letter in front."""
    top = np.abs(rows).max(initial=0)
    kind = "b" if top < 1 << 7 else "h" if top < 1 << 15 else "i" if top < 1 << 31 else "d"
    return kind.encode() + np.ascontiguousarray(rows, dtype=kind).tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    flat = np.frombuffer(raw[1:], raw[:1].decode()).astype(np.float64)
    return flat.reshape(-1, width) if width else np.zeros((0, 0))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as longs."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T
    return np.vectorize(lambda v: min(max(v, -(1 << 63)), (1 << 63) - 1), otypes=[object])(exact).astype(np.int64)


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def quantized(frame: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, vec``: floor(scale * component) of every usable vector, packed."""
    sound = F.col(id_col).isNotNull() & F.forall(
        F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    rows = frame.filter(F.col(vector_col).isNotNull() & sound).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")
    )

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: pack(np.floor(np.asarray(v, float) * scale)))

    return rows.select("id", packed("v").alias("vec"))


def matrix(vectors: list[bytes]) -> np.ndarray:
    """Packed vectors as rows, zero-padded to the longest."""
    rows = [np.frombuffer(v[1:], v[:1].decode()).astype(np.float64) for v in vectors]
    width = max((r.size for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : r.size] = r
    return out


def routes(vectors: DataFrame, most: int) -> list[bytes]:
    """At most ``most`` distinct routing objects, by hash order of the ids."""
    chosen = vectors.orderBy(unit_hash(F.col("id"), seed=5), "id", "vec").limit(most).collect()
    return sorted({bytes(r["vec"]) for r in chosen})


def build(vectors: DataFrame, most_routes: int = ROUTES, page: int = PAGE, subtree: int = SUBTREE) -> DataFrame:
    """The tree's subtrees, one row each, numbered as they are made: write them before use. Range partitioning over (route, distance, id) deals out hot routes too."""
    pivots = routes(vectors, most_routes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centers = matrix(pivots)
        for b in batches:
            if not len(b):
                continue
            x = matrix([bytes(v) for v in b["vec"]])
            width = max(x.shape[1], centers.shape[1])
            x, c = widened(x, width), widened(centers, width)
            square = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * (x @ c.T), 0)
            near = square.argmin(1)
            far = np.sqrt(((x - c[near]) ** 2).sum(1))
            yield pd.DataFrame({"route": near.astype("int32"), "far": far, "id": b["id"], "vec": b["vec"]})

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < 4 * subtree:
                continue
            rows = pd.concat(held, ignore_index=True)
            whole = len(rows) // subtree * subtree
            for at in range(0, whole, subtree):
                yield node(rows.iloc[at : at + subtree], next(numbers))
            held = [rows.iloc[whole:]]
        rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        for at in range(0, len(rows), subtree):
            yield node(rows.iloc[at : at + subtree], next(numbers))

    def node(rows: pd.DataFrame, number: int) -> pd.DataFrame:
        x = matrix([bytes(v) for v in rows["vec"]])
        route, far, ids = rows["route"].to_numpy(), rows["far"].to_numpy(), rows["id"].to_numpy("int64")
        new = np.flatnonzero(np.diff(route)) + 1
        starts = sorted({s for a, b in zip([0, *new], [*new, len(rows)]) for s in range(a, b, page)})
        centers = matrix(pivots)[route[starts]]
        width = max(x.shape[1], centers.shape[1])
        radius = np.maximum.reduceat(far, starts)
        return pd.DataFrame({
            "subtree": [number], "ids": [ids.tobytes()], "vecs": [pack(widened(x, width))],
            "width": [width], "starts": [np.asarray(starts, "int64").tobytes()], "centers": [pack(widened(centers, width))],
            "parent": [far.tobytes()], "radius": [radius.tobytes()],
        })

    dealt = vectors.mapInPandas(assign, "route int, far double, id long, vec binary")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartitionByRange(parts, "route", "far", "id").sortWithinPartitions("route", "far", "id", "vec").mapInPandas(pages, TREE)


class Pages:
    """The pages of some subtrees side by side, padded to one width."""

    def __init__(self, rows: list):
        self.width = width = max((int(r.width) for r in rows), default=0)
        exact = np.float32 if all(r.vecs[:1] in (b"b", b"h") for r in rows) else np.float64
        ids = [np.frombuffer(r.ids, np.int64) for r in rows]
        starts = [np.frombuffer(r.starts, np.int64) for r in rows]
        sizes = np.array([i.size for i in ids], np.int64)
        self.x, self.centers = np.zeros((sizes.sum(), width), exact), np.zeros((sum(s.size for s in starts), width))
        at = page = 0
        for r, i, s in zip(rows, ids, starts):
            if r.width:
                self.x[at : at + i.size, : r.width] = unpack(r.vecs, int(r.width))
                self.centers[page : page + s.size, : r.width] = unpack(r.centers, int(r.width))
            at, page = at + i.size, page + s.size
        self.ids = np.concatenate(ids)
        self.starts = np.concatenate([s + k for s, k in zip(starts, np.cumsum(sizes) - sizes)])
        self.ends = np.append(self.starts[1:], self.ids.size)
        self.parent = np.concatenate([np.frombuffer(r.parent, np.float64) for r in rows])
        self.radius = np.concatenate([np.frombuffer(r.radius, np.float64) for r in rows])
        self.subtree = np.repeat([int(r.subtree) for r in rows], [s.size for s in starts])
        self.top = np.abs(self.x).max(initial=0)

    def scores(self, q: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Exact inner products of queries (as wide as the pages) and entries: whole numbers, of any type."""
        x, most = self.x[entries], float(np.abs(q).max(initial=0)) * float(self.top) * max(self.width, 1)
        if most < EXACT_SINGLE:
            return q.astype(np.float32) @ x.astype(np.float32, copy=False).T
        return q @ x.astype(np.float64, copy=False).T if most < EXACT else inner(q, x.astype(np.float64, copy=False))

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, floor_ids: np.ndarray, k: int, skip: int | None = None):
        """``scores, ids, found``: per query the k best entries (``found`` of them) that are above its floor, by score and then
        smaller id; entries of the query's own id and of subtree ``skip`` are left out."""
        floors, floor_ids = floors.copy(), floor_ids.copy()
        length = np.sqrt((queries**2).sum(1))
        q = widened(queries[:, : self.width], self.width)
        near = q @ self.centers.T
        slack = 1e-9 * (np.abs(near) + length[:, None] * self.radius) + 1e-6
        bound = near + length[:, None] * self.radius + slack
        best_s, best_i = np.full((own.size, k), LOWEST), np.full((own.size, k), -1, np.int64)
        found = np.zeros(own.size, np.int64)
        order = np.argsort(-bound.max(0, initial=-np.inf), kind="stable")
        if skip is not None:
            order = order[self.subtree[order] != skip]
        for first in range(0, order.size, STEP):
            pages = order[first : first + STEP]
            low = np.where(floors == LOWEST, -np.inf, floors.astype(np.float64))
            live = bound[:, pages] >= low[:, None]
            rows, pages = np.flatnonzero(live.any(1)), pages[live.any(0)]
            if not rows.size:
                continue
            short = (low[rows, None] - near[np.ix_(rows, pages)] - slack[np.ix_(rows, pages)]) / np.where(length[rows] > 0, length[rows], 1)[:, None]
            least = np.where(length[rows, None] > 0, short, -np.inf).min(0)
            many = self.ends[pages] - self.starts[pages]
            entries = np.arange(many.sum()) + np.repeat(self.starts[pages] - np.cumsum(many) + many, many)
            entries = entries[self.parent[entries] >= np.repeat(least, many)]
            if not entries.size:
                continue
            s, ids = self.scores(q[rows], entries), self.ids[entries]
            reach = low[rows] if s.dtype.kind == "f" else floors[rows]
            r, c = np.nonzero(s >= reach.astype(s.dtype)[:, None])
            if r.size > 4 * k * rows.size:
                s = np.where(ids == own[rows][:, None], LOWEST if s.dtype.kind == "i" else -np.inf, s)
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
                r, c = np.nonzero(s >= np.maximum(kth, reach.astype(s.dtype))[:, None])
            s, i, r = s[r, c], ids[c], rows[r]
            other = i != own[r]
            s, i, r = s[other].astype(np.int64), i[other], r[other]
            good = (s > floors[r]) | (s == floors[r]) & (i < floor_ids[r])
            s, i, r = s[good], i[good], r[good]
            if not r.size:
                continue
            new = np.unique(r)
            old = np.repeat(new, found[new])
            place = np.arange(old.size) - np.repeat(np.cumsum(found[new]) - found[new], found[new])
            s, i, r = np.append(s, best_s[old, place]), np.append(i, best_i[old, place]), np.append(r, old)
            ranked = np.lexsort((i, ~s, r))
            s, i, r = s[ranked], i[ranked], r[ranked]
            place = np.arange(r.size) - np.searchsorted(r, r)
            top = place < k
            best_s[r[top], place[top]], best_i[r[top], place[top]] = s[top], i[top]
            found[new] = np.bincount(r[top], minlength=own.size)[new]
            full = new[found[new] == k]
            floors[full], floor_ids[full] = best_s[full, -1], best_i[full, -1]
        return best_s, best_i, found


def grid(subtrees: int, tasks: int) -> tuple[int, int]:
    """Rows (of query blocks) and columns (of subtrees) of the grid: at least about ``tasks / 2`` cells, none too large."""
    columns = max(-(-subtrees // CELL), min(subtrees, math.isqrt(2 * tasks)))
    rows = max(-(-subtrees // (16 * CELL)), min(subtrees, -(-tasks // (2 * columns)) if columns else 0))
    return max(rows, 1), max(columns, 1)


def query_key(vector: np.ndarray) -> int:
    return int(pd.util.hash_array(np.array([vector.tobytes()], dtype=object))[0].view(np.int64))


def top_inner_products(
    frame: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding",
    most_routes: int = ROUTES, page: int = PAGE, subtree: int = SUBTREE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row whose id is divisible by ``every``."""
    tree = written(build(quantized(frame, id_col, vector_col, scale), most_routes, page, subtree), "mtree")

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                t = Pages([row])
                asked = np.flatnonzero(t.ids % every == 0)
                if not asked.size:
                    continue
                seen = {(int(t.ids[j]), t.x[j].tobytes()): j for j in asked}
                asked = np.array(sorted(seen.values()))
                own, q = t.ids[asked], t.x[asked].astype(np.float64)
                none = np.full(asked.size, LOWEST)
                best_s, best_i, found = t.search(q, own, none, np.full(asked.size, HIGHEST), k)
                full = found == k
                floors, floor_ids = np.where(full, best_s[:, -1], LOWEST), np.where(full, best_i[:, -1], HIGHEST)
                yield pd.DataFrame({
                    "block": [row.subtree], "query_ids": [own.tobytes()], "queries": [pack(q)], "width": [t.width],
                    "floors": [floors.tobytes()], "floor_ids": [floor_ids.tobytes()],
                    "best_ids": [best_i.tobytes()], "best_scores": [best_s.tobytes()],
                })

    def hits(own, keys, scores, ids, found) -> pd.DataFrame:
        some = np.arange(k) < found[:, None]
        return pd.DataFrame({
            "query_id": np.repeat(own, found), "query_key": np.repeat(keys, found), "vec_id": ids[some], "score": scores[some],
        })

    def opened(row):
        own = np.frombuffer(row.query_ids, np.int64)
        width = int(row.width)
        q = unpack(row.queries, width) if width else np.zeros((own.size, 0))
        return own, q, np.array([query_key(v) for v in q], np.int64)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                own, _, keys = opened(row)
                scores, ids = (np.frombuffer(x, np.int64).reshape(own.size, k) for x in (row.best_scores, row.best_ids))
                yield hits(own, keys, scores, ids, (scores != LOWEST).sum(1))

    def visit(queries: pd.DataFrame, subtrees: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "query_key", "vec_id", "score")})]
        pages = Pages(list(subtrees.itertuples())) if len(subtrees) and len(queries) else None
        for row in queries.itertuples() if pages else ():
            own, q, keys = opened(row)
            floors, floor_ids = (np.frombuffer(x, np.int64) for x in (row.floors, row.floor_ids))
            out.append(hits(own, keys, *pages.search(q, own, floors, floor_ids, k, row.block)))
        return pd.concat(out, ignore_index=True)

    blocks = written(tree.mapInPandas(home, BLOCK), "query-blocks")
    rows, columns = grid(tree.count(), int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(frame: DataFrame, own: str, name: str, most: int, other: str, copies: int):
        placed = frame.withColumn(own, F.pmod(F.xxhash64(name), F.lit(most)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        return placed.repartition(rows * columns, "_row", "_column").groupBy("_row", "_column")

    asked = dealt(blocks.drop("best_ids", "best_scores"), "_row", "block", rows, "_column", columns)
    meeting = asked.cogroup(dealt(tree, "_column", "subtree", columns, "_row", rows)).applyInPandas(visit, HITS)
    found = blocks.mapInPandas(first, HITS).unionByName(meeting)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
