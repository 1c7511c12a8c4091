"""Repeated strings of ``LENGTH`` bytes by blockwise suffix sorting with a cover sample.

Two suffixes that agree in ``LENGTH`` bytes must be recognised without sorting all suffixes of a corpus at once. A cover sample
holds a few positions of every text such that equal strings meet the sample at one common shift (the property of a
difference cover). The sample here is content-defined: of every ``LENGTH``-byte string it holds the position whose 32-byte gram has the
smallest hash, the leftmost of equal ones. That takes about one position in 35, an arithmetic cover of that period one in 6.

1. Copies of whole texts are set aside. Grams at sample positions are counted; a string can be repeated only if its gram is.
2. A bucket is the suffixes that meet the sample at one repeated gram. Buckets are dealt out whole and sorted one after another in
   batches of bounded size: the sample suffixes get ranks with their common prefix lengths first, then a suffix that starts
   d bytes before its sample position is compared by these d bytes and, in a tie, by the sample's rank at depth LENGTH - d.
3. Buckets of very frequent grams, which one task should not hold, are resolved by grouping equal surroundings map-side and then
   the strings of the different surroundings.

Strings are judged on the input: a string goes where an equal one starts earlier (smaller id, then smaller place), overlaps
included. Defined cases: NULL is the empty text; texts under ``LENGTH`` bytes stay whole; NULL ids are later than all others; rows
equal in id and text are one document and get equal results; rows equal in id only are ordered by a hash; an empty table gives no rows;
input columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.paragraph_dedup import merged
from siltmark.llm.shared_keys import picked, shared_keys, split_copies
from siltmark.llm.shingles import mixed
from siltmark.llm.text import utf8_bytes, written

LENGTH = 100
GRAM = 32
WINDOW = LENGTH - GRAM + 1
#: A gram with more occurrences (some 3 MB of bucket) is resolved by grouping instead of one bucket.
FREQUENT = 20_000
BATCH = 60_000
CHUNK = 1 << 20
_LAST = np.iinfo(np.int64).max

CONTEXT = "key long, doc_id long, uid long, at int, before binary, after binary, span int"


_BYTES = np.random.default_rng(23).integers(0, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every 32-byte gram: a polynomial over random byte values, by joining halves, mixed at the end."""
    h, span, power = _BYTES[codes], 1, 0x9E3779B97F4A7C15
    while span < GRAM:
        h = h[:-span] * np.uint64(power) + h[span:]
        span, power = span * 2, power * power % (1 << 64)
    return mixed(h)


def cover_sample(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(positions, first start, last start, gram hash)``: sample positions and the starts of the strings that meet them."""
    strings = len(raw) - LENGTH + 1
    if strings <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    codes = np.frombuffer(raw, np.uint8)
    meets, keys = [], []
    for begin in range(0, strings, CHUNK):
        count = min(CHUNK, strings - begin)
        h = gram_hashes(codes[begin : begin + count + LENGTH - 1])
        place = np.uint64(CHUNK * 2 - 1)
        low = (h & ~place) | np.arange(h.size, dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = WINDOW - span
        low = np.minimum(low[: low.size - rest], low[rest:]) if rest else low
        at = (low & place).astype(np.int64)
        meets.append(at + begin)
        keys.append(h[at].view(np.int64))
    meet, key = np.concatenate(meets), np.concatenate(keys)
    turn = np.flatnonzero(np.diff(meet)) + 1
    first = np.concatenate([[0], turn])
    return meet[first], first, np.append(turn - 1, strings - 1), key[first]


def keys_of(docs: DataFrame, text_col: str) -> DataFrame:
    """``uid, keys, counts``: the grams at sample positions and how often each occurs."""

    @F.pandas_udf("keys array<long>, counts array<int>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [np.unique(cover_sample((t or "").encode())[3], return_counts=True) for t in texts]
            yield pd.DataFrame({"keys": [k for k, _ in found], "counts": [n.astype(np.int32) for _, n in found]})

    return docs.select("uid", keys(F.col(text_col)).alias("_k")).select("uid", "_k.*")


def surroundings(docs: DataFrame, shared: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for every sample position with a repeated gram: the bytes its strings hold before and from it on.

    A position whose bytes stand at an earlier one of the same text is a row of ``span`` bytes to remove and nothing else, so a
    text that repeats itself stays as small as it is.
    """

    def spots(raw: bytes, wanted: np.ndarray) -> list[tuple[int, int, bytes, bytes, int]]:
        at, first, last, key = cover_sample(raw)
        k = np.flatnonzero(np.isin(key, wanted))
        found = list(zip(key[k].tolist(), at[k].tolist(), first[k].tolist(), last[k].tolist()))
        if len(np.unique(key[k])) == k.size:
            return [(g, a, raw[f:a], raw[a : b + LENGTH], 0) for g, a, f, b in found]
        seen, out = set(), []
        for g, a, f, b in found:
            whole = (a - f, raw[f : b + LENGTH])
            if whole in seen:
                out.append((None, f, b"", b"", b + LENGTH - f))
            else:
                seen.add(whole)
                out.append((g, a, raw[f:a], raw[a : b + LENGTH], 0))
        return out

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows_, sizes = [], []
            for text, wanted in zip(batch["text"], batch["shared"]):
                found = spots(text.encode(), np.asarray(wanted, np.int64))
                rows_ += found
                sizes.append(len(found))
            key, at, before, after, span = zip(*rows_) if rows_ else ((),) * 5
            uid = np.repeat(batch["uid"].to_numpy("int64"), sizes)
            doc_id = np.repeat(batch["doc_id"].to_numpy("int64"), sizes)
            key = [u if k is None else k for k, u in zip(key, uid.tolist())]  # spans are dealt out by document
            yield pd.DataFrame({"key": key, "doc_id": doc_id, "uid": uid, "at": at, "before": before, "after": after, "span": span})

    rows = docs.select("uid", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.col(text_col).alias("text")).dropDuplicates(["uid"])
    return rows.join(shared, "uid").mapInPandas(find, CONTEXT)


def _ranks(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, common)``: the sorted order and the length of the common prefix with the one before."""
    order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
    flat = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(len(strings), width)[order]
    size = np.array([len(s) for s in strings], np.int64)[order]
    common = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        differ = flat[1:] != flat[:-1]
        lead = np.where(differ.any(1), differ.argmax(1), width)
        common[1:] = np.minimum(lead, np.minimum(size[1:], size[:-1]))
    return order, common


def later_strings(rows: pd.DataFrame) -> pd.DataFrame:
    """``uid, start, end`` of the strings in whole buckets that an earlier row has too, and of the rows of a span."""
    given = rows[rows["span"] > 0]
    direct = pd.DataFrame({"uid": given["uid"], "start": given["at"].astype("int64"), "end": given["at"].astype("int64") + given["span"]})
    rows = rows[rows["span"] == 0]
    if not len(rows):
        return direct
    rows = rows.iloc[np.lexsort((rows["at"], rows["uid"], rows["doc_id"]))]
    before, after = rows["before"].tolist(), rows["after"].tolist()
    names = [k.to_bytes(8, "big", signed=True) for k in rows["key"].tolist()]
    right, right_common = _ranks([n + s for n, s in zip(names, after)], LENGTH + 8)
    left, left_common = _ranks([n + s[::-1] for n, s in zip(names, before)], WINDOW + 7)
    at = rows["at"].to_numpy().astype(np.int64)
    reach = np.array([len(s) for s in before], np.int64)
    least = LENGTH - np.array([len(s) for s in after], np.int64)
    uid = rows["uid"].to_numpy()
    starts, owners = [], []
    rank = np.zeros((2, len(rows)), np.int64)
    for shift in range(WINDOW):
        live = np.flatnonzero((least <= shift) & (shift <= reach))
        if live.size < 2:
            continue
        rank[0][left] = np.cumsum(left_common < shift + 8)
        rank[1][right] = np.cumsum(right_common < LENGTH - shift + 8)
        _, first = np.unique(rank[0][live] * len(rows) + rank[1][live], return_index=True)
        again = np.ones(live.size, bool)
        again[first] = False
        again = live[again]
        starts.append(at[again] - shift)
        owners.append(uid[again])
    return pd.concat([direct, joined(np.concatenate(owners), np.concatenate(starts))]) if starts else direct


def joined(uid: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Byte ranges that the strings starting at ``start`` cover, joined where they touch."""
    order = np.lexsort((start, uid))
    uid, start = uid[order], start[order]
    new = np.flatnonzero((uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + LENGTH)) + 1
    first = np.concatenate([[0], new]) if uid.size else new
    last = np.append(new - 1, uid.size - 1) if uid.size else new
    return pd.DataFrame({"uid": uid[first], "start": start[first], "end": start[last] + LENGTH})


def by_buckets(rows: DataFrame) -> DataFrame:
    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < BATCH:
                continue
            frame = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(frame["key"].to_numpy(), frame["key"].iloc[-1]))
            if cut:
                yield later_strings(frame.iloc[:cut])
            held = [frame.iloc[cut:]]
            size = len(frame) - cut
        if size:
            yield later_strings(pd.concat(held, ignore_index=True))

    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(sort, "uid long, start long, end long")


def by_strings(rows: DataFrame) -> DataFrame:
    """The same for frequent grams: equal surroundings are one row of their earliest place, whose strings are grouped."""
    place = F.struct("doc_id", "uid", "at")
    hashed = rows.withColumn("surround", F.struct(F.xxhash64("before", "after"), F.xxhash64("after", F.lit(1), "before")))
    distinct = written(
        hashed.groupBy("surround").agg(F.min(place).alias("first"), F.first("before").alias("before"), F.first("after").alias("after")),
        "surroundings",
    )

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, uid, at, before, after in batch.itertuples(index=False):
                raw, start = before + after, at - len(before)
                digests = [hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest() for k in range(len(raw) - LENGTH + 1)]
                yield pd.DataFrame({"string": digests, "doc_id": doc_id, "uid": uid, "start": np.arange(start, start + len(digests))})

    opened = distinct.select("first.*", "before", "after").mapInPandas(strings, "string binary, doc_id long, uid long, start long")
    opened = written(opened, "strings")
    mine = F.struct("doc_id", "uid", "start")
    earliest = opened.groupBy("string").agg(F.min(mine).alias("earliest"))
    again = opened.join(earliest, "string").filter(mine != F.col("earliest")).select("uid", "start", (F.col("start") + LENGTH).alias("end"))
    start = (F.col("at") - F.length("before")).cast("long")
    others = hashed.join(distinct.select("surround", "first"), "surround").filter(place != F.col("first"))
    return again.union(others.select("uid", start.alias("start"), (F.col("at") + F.length("after")).cast("long").alias("end")))


def repeated_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid, spans`` (array of byte ranges) of one row per text."""
    keyed = written(keys_of(docs, text_col), "sample-keys")
    weighted = keyed.select(F.explode(F.arrays_zip("keys", "counts")).alias("k")).select(F.col("k.keys").alias("key"), F.col("k.counts").alias("n"))
    shared = written(shared_keys(keyed), "shared-keys")
    often = written(
        weighted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT).select("key"),
        "frequent-keys",
    )
    rows = surroundings(picked(docs, shared.select("uid"), "left_semi"), shared, id_col, text_col)
    if often.count():
        rows = written(rows, "surroundings-all")
        ranges = by_buckets(rows.join(often, "key", "left_anti")).union(by_strings(rows.join(often, "key", "left_semi")))
    else:
        ranges = by_buckets(rows)
    return ranges.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def without_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_bytes``."""
    made = {"n_bytes", "n_removed", "n_spans", "kept_bytes", "uid"}
    keep = [c for c in docs.columns if c not in made]
    rows, copies = split_copies(docs.select(*keep), id_col, text_col)
    unique = picked(rows.select("uid", F.col(id_col), F.col(text_col)), copies, "left_anti")
    spans = written(repeated_ranges(unique, id_col, text_col), "ranges")

    @F.pandas_udf("n_removed long, n_spans long, kept_bytes binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges in batches:
            out = []
            for text, found in zip(texts, ranges):
                raw = (text or "").encode()
                gone = merged((s["start"], s["end"]) for s in found)
                pieces, at = [], 0
                for a, b in gone:
                    pieces.append(raw[at:a])
                    at = b
                out.append((sum(b - a for a, b in gone), len(gone), b"".join(pieces) + raw[at:]))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_bytes"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    n_bytes = utf8_bytes(F.col(text_col)).alias("n_bytes")

    def plain(frame: DataFrame, gone) -> DataFrame:
        return frame.select(
            *keep, n_bytes, F.when(gone, F.octet_length(text)).otherwise(0).cast("long").alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
            F.when(gone, F.lit("")).otherwise(text).cast("binary").alias("kept_bytes"),
        )

    ids = written(spans.select("uid").union(copies).distinct(), "touched")
    whole = plain(picked(rows, copies, "left_semi"), F.octet_length(text) >= LENGTH)
    untouched = plain(picked(rows, ids, "left_anti"), F.lit(False))
    touched = picked(rows, written(spans.select("uid"), "cut"), "left_semi").join(spans, "uid")
    changed = touched.select(*keep, n_bytes, cut(F.col(text_col), F.col("spans")).alias("_c")).select(*keep, "n_bytes", "_c.*")
    return untouched.unionByName(whole).unionByName(changed)
