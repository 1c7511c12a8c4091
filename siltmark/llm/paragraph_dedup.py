"""Repeated passages by MinHash banding of paragraphs.

A paragraph is a stretch of ``WORDS`` words from the start of a sentence or line, in long ones also from every ``STEP``-th word
on, and from every word whose shingle hash is the smallest of ``REACH`` starts in a row. The last depend on nothing but these
words, so any passage of ``WORDS + REACH - 1`` words has a common paragraph wherever it stands, with or without sentences, the
first and the last at most ``REACH - 1`` words from its ends. The bands of a paragraph are its three smallest shingle hashes:
of two full paragraphs (``WORDS - 4`` different shingles each) with a Jaccard similarity of 0.8 or more, at most two shingles
are missing from the other, so at least one of three smallest is shared: recall is 1 by count, not by chance.

1. Copies of whole texts are set aside. Bands of all other paragraphs are counted; documents with a shared band go on.
2. Their paragraphs with a shared band are classes of equal shingle sets. Classes that collide in a band are verified on exact
   sets, in blocks of bounded size whose pairs never leave the task: only links do.
3. Components of links are clusters. In each the earliest document keeps its text; the paragraphs of all other documents go.
4. They grow on both sides over the words that an earlier document of the cluster has there too, up to ``REACH - 1`` words,
   which is as far as an end can be. Words beside paragraphs are sorted for that, in ranges of even size.

Defined cases: NULL is the empty text; texts under ``WORDS`` words have no paragraph and stay whole; a longer copy of
an earlier whole text loses all of it; repetitions inside one document stay; rows equal in id and text are one document and get equal
results; NULL ids are later than all others; an empty table gives no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.components import components
from siltmark.llm.shared_keys import picked, shared_keys, split_copies
from siltmark.llm.shingles import mixed, shingles_in_a_row, word_hashes
from siltmark.llm.text import utf8_bytes, written

WORDS = 24
STEP = 16
#: Starts in a row of which one is taken by its hash: those of a passage of 51 words.
REACH = 51 - WORDS + 1
SHINGLE = 5
BANDS = 3
#: Shorter sentences give no start of their own; starts by hash are in them too.
LEAST_SENTENCE = 3
BLOCK = 1024
#: Classes of a larger band that are counted to tell its frequent shingles.
RARITY = 512
#: Groups up to this size are compared together, larger ones one by one.
SMALL = 48
#: Characters of texts whose paragraphs are found at once.
PORTION = 1 << 19
#: Rows of classes that are taken before their groups are compared.
HELD = 1 << 14
#: Rows of sorted words that are compared at a time.
CHUNK = 1 << 15

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def document_order() -> Column:
    """Earlier documents are smaller."""
    return F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the words."""
    inside = np.concatenate([[False], ~_WHITE[np.frombuffer(raw, np.uint8)], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def sliding(values: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every ``size`` values in a row."""
    done = 1
    out = values
    while done < size:
        step = min(done, size - done)
        out = op(out[:-step], out[step:])
        done += step
    return out


def starts_by_hash(hashes: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places whose hash is the smallest of some ``REACH`` in a row (of all, if there are fewer); equal ones all count. A text has
    ``count`` places from ``begin`` on."""
    begin, count = begin[count > 0], count[count > 0]
    if not begin.size:
        return np.zeros(0, np.int64)
    place = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
    smallest = np.zeros(hashes.size, np.uint64)
    if hashes.size >= REACH:
        whole = np.arange(count.sum()) + REACH - 1 < np.repeat(np.cumsum(count), count)
        smallest[place[whole]] = sliding(hashes, REACH, np.minimum)[place[whole]]
    most = sliding(np.concatenate([np.zeros(REACH - 1, np.uint64), smallest]), REACH, np.maximum)[place]
    least = np.minimum.reduceat(hashes[place], np.cumsum(count) - count)
    most = np.where(np.repeat(count < REACH, count), np.repeat(least, count), most)
    return place[hashes[place] == most]


def windows(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Paragraphs of all texts at once: ``(hashes, starts, ends, first, at, sets)`` with the hash and the first and end bytes (in the
    texts joined by a byte) of every word, the number of the first word of every text (and the number of words), the first words of
    paragraphs and their sorted shingle hashes; repeated shingles are at the row's end as the largest number."""
    raws = [(t or "").encode() for t in texts]
    raw = b"\n".join(raws)
    hashes = word_hashes(raw.lower().split())
    starts, ends = word_bounds(raw)
    byte = np.cumsum([0, *[len(r) + 1 for r in raws]])
    first = np.searchsorted(starts, byte)
    count = np.maximum(np.diff(first) - WORDS + 1, 0)
    if not count.any():
        return hashes, starts, ends, first, np.zeros(0, np.int64), np.zeros((0, WORDS - SHINGLE + 1), np.uint64)
    codes = np.frombuffer(raw, np.uint8)
    lines = np.cumsum(codes == 10, dtype=np.int32)
    closed = _STOP[codes[ends - 1]]
    closed[:-1] |= lines[starts[1:]] > lines[ends[:-1] - 1]
    sentence = np.concatenate([[0], np.flatnonzero(closed[:-1]) + 1])
    length = np.diff(np.append(sentence, starts.size))
    sentence, length = sentence[length >= LEAST_SENTENCE], length[length >= LEAST_SENTENCE]
    parts = np.where(length > WORDS, (length + STEP - 1) // STEP, 1)
    offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    shingled = shingles_in_a_row(hashes, SHINGLE)
    taken = np.zeros(starts.size, bool)
    taken[np.repeat(sentence, parts) + STEP * offset] = True
    taken[starts_by_hash(shingled, first[:-1], count)] = True
    taken &= np.arange(starts.size) + WORDS <= np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(taken)
    sets = np.sort(np.lib.stride_tricks.sliding_window_view(shingled, WORDS - SHINGLE + 1)[at], axis=1)
    again = sets[:, 1:] == sets[:, :-1]
    k = np.flatnonzero(again.any(1))
    if k.size:
        some = sets[k]
        some[:, 1:][again[k]] = np.iinfo(np.uint64).max
        sets[k] = np.sort(some, axis=1)
    return hashes, starts, ends, first, at, sets


def paragraphs(text: str | None, memo: object = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first bytes, end bytes, sorted shingle hashes)`` of a text's paragraphs; ``memo`` is not needed any more."""
    _, starts, ends, _, at, sets = windows([text])
    return starts[at], ends[at + WORDS - 1], sets


def portions(texts: pd.Series) -> Iterator[slice]:
    """Parts of a batch of about ``PORTION`` characters, so that one of long texts takes no more memory."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= PORTION:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def class_of(sets: np.ndarray) -> np.ndarray:
    """One number per row of hashes."""
    out = np.full(len(sets), 7, np.uint64)
    for k in range(sets.shape[1]):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + sets[:, k])
    return out.view(np.int64)


def bands_of(docs: DataFrame, text_col: str) -> DataFrame:
    @F.pandas_udf("array<long>")
    def bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for part in portions(texts):
                *_, first, at, sets = windows(texts[part].tolist())
                keys = sets[:, :BANDS].view(np.int64).ravel()
                text = np.repeat(np.searchsorted(first, at, "right") - 1, BANDS)
                real = keys != -1  # the number at the end of sets of fewer shingles is none of them
                keys, text = keys[real], text[real]
                order = np.lexsort((keys, text))
                keys, text = keys[order], text[order]
                new = np.append(True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))[: keys.size]
                out += np.split(keys[new], np.searchsorted(text[new], np.arange(1, first.size - 1)))
            yield pd.Series(out)

    return docs.select("uid", bands(F.col(text_col)).alias("keys"))


def colliding(docs: DataFrame, shared: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid, doc_id, at, class, b0, b1, b2, shingles, left, right`` of the paragraphs that hold a shared band; a band that is not
    shared is NULL. ``at`` is the first word; ``left`` and ``right`` have four bytes for each word beside it, the nearest first."""
    fields = "uid long, doc_id long, at int, class long, b0 long, b1 long, b2 long, hits int, shingles binary, left binary, right binary"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, left, right = [], [], []
            for part in portions(batch["text"]):
                hashes, _, _, first, at, sets = windows(batch["text"][part].tolist())
                # a band that is shared anywhere is in the lists of all that have it
                hit = np.isin(sets[:, :BANDS].view(np.int64), np.concatenate(batch["shared"][part].tolist()))
                k = np.flatnonzero(hit.any(1))
                text = np.searchsorted(first, at[k], "right") - 1
                found.append((at[k] - first[text], part.start + text, sets[k], hit[k]))
                marks = (hashes >> np.uint64(32)).astype(np.uint32)
                ahead, back = marks.tobytes(), marks[::-1].tobytes()
                begin = 4 * (marks.size - at[k])
                end = 4 * (marks.size - np.maximum(first[text], at[k] - REACH + 1))
                left += [back[a:b] for a, b in zip(begin.tolist(), end.tolist())]
                begin, end = 4 * (at[k] + WORDS), 4 * np.minimum(first[text + 1], at[k] + WORDS + REACH - 1)
                right += [ahead[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            if not found:
                continue
            at, row, sets, hit = (np.concatenate(x) for x in zip(*found))
            raw = (sets >> np.uint64(32)).astype(np.uint32).tobytes()
            step = 4 * sets.shape[1]
            classes = class_of(sets)
            shingles = np.full(len(sets), None, object)
            for k in np.unique(classes, return_index=True)[1].tolist():  # once a batch is enough
                shingles[k] = raw[step * k : step * k + step]
            yield pd.DataFrame({
                "uid": batch["uid"].to_numpy("int64")[row], "doc_id": batch["doc_id"].to_numpy("int64")[row],
                "at": at.astype("int32"), "class": classes,
                **{f"b{j}": np.ascontiguousarray(sets[:, j]).view(np.int64) for j in range(BANDS)},
                "hits": (hit * (1 << np.arange(BANDS))).sum(1).astype("int32"),
                "shingles": shingles, "left": left, "right": right,
            })

    last = F.lit(int(np.iinfo(np.int64).max))
    rows = docs.select("uid", F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.col(text_col).alias("text")).dropDuplicates(["uid"])
    out = rows.join(shared, "uid").mapInPandas(find, fields)
    known = {f"b{j}": F.when(F.col("hits").bitwiseAND(1 << j) != 0, F.col(f"b{j}")) for j in range(BANDS)}
    return out.withColumns({**known, "doc_id": F.nullif("doc_id", last)}).drop("hits")


def first_by_rarity(hot: DataFrame, percent: int) -> DataFrame:
    """``band, class`` -> ``band, class, m`` for bands with very many classes: two classes that may be linked have one of them in
    common, and few others do.

    Sets of which ``percent`` of the larger are shared have a shingle in common among as many of the first as may be missing and
    one more, whatever the order, if all use the same. Rare ones come first here: counts of some ``RARITY`` classes of a band give
    the order and nothing else, so no link depends on which these are.
    """
    some = hot.filter(F.pmod(F.xxhash64("class"), F.col("m")) < RARITY).select("band", F.col("shingles"))
    words = some.select("band", F.explode(F.sequence(F.lit(1), F.octet_length("shingles"), F.lit(4))).alias("k"), "shingles")
    counts = words.groupBy("band", F.substring("shingles", F.col("k"), F.lit(4)).alias("shingle")).agg(F.count("*").alias("n"))
    often = counts.filter("n > 1").groupBy("band").agg(F.collect_list("shingle").alias("often"), F.collect_list(F.col("n").cast("int")).alias("times"))

    @F.pandas_udf("array<long>")
    def firsts(bands: pd.Series, sets: pd.Series, often: pd.Series, times: pd.Series) -> pd.Series:
        words = np.frombuffer(b"".join(sets), np.uint32).reshape(len(sets), -1)
        times_of = np.zeros(words.shape, np.int32)
        group = pd.factorize(bands)[0]
        for g in range(group.max(initial=-1) + 1):
            rows = np.flatnonzero(group == g)
            if often.iloc[rows[0]] is not None:
                names = np.frombuffer(b"".join(map(bytes, often.iloc[rows[0]])), np.uint32)
                by_name = np.argsort(names)
                place = np.minimum(np.searchsorted(names, words[rows], sorter=by_name), names.size - 1)
                times_of[rows] = np.where(names[by_name][place] == words[rows], np.asarray(times.iloc[rows[0]], np.int32)[by_name][place], 0)
        none = words == np.iinfo(np.uint32).max
        times_of[none] = np.iinfo(np.int32).max
        order = np.argsort(times_of.astype(np.int64) << 32 | words, axis=1)
        words = np.take_along_axis(words, order, axis=1).astype(np.int64)
        size = (~none).sum(1)
        most = size - -(-percent * size // 100) + 1
        return pd.Series([row[:k] for row, k in zip(words, most)])

    keys = F.explode(firsts("band", "shingles", "often", "times")).alias("key")
    rows = hot.join(often, "band", "left").select("band", "class", keys)
    rows = written(rows.select(F.xxhash64("band", "key").alias("band"), "class").distinct(), "rare-bands")
    many = rows.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    return rows.join(many, "band").select("band", "class", "m")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``a - b`` connect: every node with the least it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: a.size], at[a.size :]
    root = np.arange(nodes.size)
    while x.size:
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    other = np.flatnonzero(root != np.arange(nodes.size))
    return nodes[root[other]], nodes[other]


def links_of(found: DataFrame, percent: int, every: bool = True) -> DataFrame:
    """``a, b``: classes of one band whose sets have 100 * intersection >= percent * union.

    Without ``every``, links that connect the same classes: at most as many as a task's classes.

    Bands of more than ``BLOCK`` classes are cut by their rare shingles. Bands are dealt in blocks of about ``BLOCK`` classes;
    every pair of blocks meets in one task, where sets are compared as sparse rows. A band of any size is thus compared wholly,
    and memory holds two blocks.
    """
    bands = F.array_compact(F.array(*[f"b{j}" for j in range(BANDS)]))
    rows = found.select(F.explode(bands).alias("band"), "class").distinct()
    many = rows.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
    rows = written(rows.join(many, "band"), "bands")

    def with_sets(classes: DataFrame) -> DataFrame:
        sets = found.join(classes.select("class").distinct(), "class", "left_semi").filter("shingles IS NOT NULL").groupBy("class").agg(F.min("shingles").alias("shingles"))
        return classes.join(sets, "class")

    large = F.col("m") > BLOCK
    hot = written(with_sets(rows.filter(large)), "hot-bands")
    rows = rows.filter(~large).select("band", "class", "m").union(first_by_rarity(hot, percent))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = with_sets(rows).withColumn("_of", blocks).withColumn("_mine", F.pmod(F.xxhash64("class"), F.col("_of")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).select(
        "band", F.least("_mine", "_other").alias("low"), F.greatest("_mine", "_other").alias("high"), "_mine", "class", "shingles"
    )

    def small(classes: np.ndarray, mine: np.ndarray, sets: np.ndarray, group: np.ndarray, split: np.ndarray):
        """Pairs of the groups of at most ``SMALL`` classes, all groups at once."""
        first, second = [], []
        for gap in range(1, SMALL):
            k = np.flatnonzero(group[gap:] == group[:-gap])
            if not k.size:
                break
            first.append(k)
            second.append(k + gap)
        if not first:
            return
        a, b = np.concatenate(first), np.concatenate(second)
        other = ~split[a] | (mine[a] != mine[b])
        a, b = a[other], b[other]
        size = (sets != np.iinfo(np.uint32).max).sum(1)
        for at in range(0, a.size, 8192):
            i, j = a[at : at + 8192], b[at : at + 8192]
            both = np.sort(np.concatenate([sets[i], sets[j]], axis=1), axis=1)
            shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != np.iinfo(np.uint32).max)).sum(1)
            good = shared * 100 >= percent * (size[i] + size[j] - shared)
            if good.any():
                yield pd.DataFrame({"a": classes[i[good]], "b": classes[j[good]]})

    def close(classes: np.ndarray, mine: np.ndarray, sets: np.ndarray, low: int, high: int):
        """Pairs of one block, or of a class of each of two blocks."""
        if len(classes) == 1:
            return
        order = np.argsort(mine, kind="stable")
        classes, sets = classes[order], sets[order]
        one = int((mine == low).sum()) if low != high else 0
        if low != high and one in (0, len(classes)):
            return
        size = (sets != np.iinfo(np.uint32).max).sum(1)
        names, at = np.unique(sets, return_inverse=True)
        at = at.reshape(sets.shape)
        other = names[at] != np.iinfo(np.uint32).max
        row = np.repeat(np.arange(len(classes)), other.sum(1))
        item = at[other]
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        bounds = np.flatnonzero(np.diff(item)) + 1
        common = np.zeros((one or len(classes), len(classes) - one), np.uint8)
        for group in np.split(row, bounds):
            split = np.searchsorted(group, one)
            if one and 0 < split < group.size:
                common[np.ix_(group[:split], group[split:] - one)] += 1
            elif not one and group.size > 1:
                common[np.ix_(group, group)] += 1
        shared = common.astype(np.int64)
        good = shared * 100 >= percent * (size[: common.shape[0], None] + size[None, one:] - shared)
        if low == high:
            good = np.triu(good, 1)
        a, b = np.nonzero(good)
        if a.size:
            yield pd.DataFrame({"a": classes[a], "b": classes[one + b]})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, more, rows_ = None, [], 0
        for batch in batches:
            more.append(batch)
            rows_ += len(batch)
            if rows_ < HELD:
                continue
            held, more, rows_ = pd.concat([*([] if held is None else [held]), *more], ignore_index=True), [], 0
            keys = held[["band", "low", "high"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            if not cuts.size:
                continue
            done, held = held.iloc[: cuts[-1]], held.iloc[cuts[-1] :]
            yield from groups(done, keys, cuts)
        held = pd.concat([*([] if held is None else [held]), *more], ignore_index=True) if held is not None or more else None
        if held is not None and len(held):
            keys = held[["band", "low", "high"]].to_numpy()
            yield from groups(held, keys, np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(held)))

    def groups(rows_: pd.DataFrame, keys: np.ndarray, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        if every:
            yield from pairs(rows_, keys, cuts)
            return
        found_: list[tuple[np.ndarray, np.ndarray]] = []
        for part in pairs(rows_, keys, cuts):
            found_.append((part["a"].to_numpy(), part["b"].to_numpy()))
            if sum(x.size for x, _ in found_) > 1 << 20:
                found_ = [forest(*map(np.concatenate, zip(*found_)))]
        if found_:
            a, b = forest(*map(np.concatenate, zip(*found_)))
            yield pd.DataFrame({"a": a, "b": b})

    def pairs(rows_: pd.DataFrame, keys: np.ndarray, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        classes, mine = rows_["class"].to_numpy(), rows_["_mine"].to_numpy()
        sets_ = np.frombuffer(b"".join(rows_["shingles"]), np.uint32).reshape(len(rows_), -1)
        begins = np.concatenate([[0], cuts[:-1]])
        sizes = cuts - begins
        few = np.repeat(sizes <= SMALL, sizes)
        k = np.flatnonzero(few)
        yield from small(classes[k], mine[k], sets_[k], np.repeat(np.arange(cuts.size), sizes)[k], keys[k, 1] != keys[k, 2])
        for begin, end in zip(begins[sizes > SMALL].tolist(), cuts[sizes > SMALL].tolist()):
            yield from close(classes[begin:end], mine[begin:end], sets_[begin:end], int(keys[begin][1]), int(keys[begin][2]))

    placed = dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    return placed.mapInPandas(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def open_sides(gone: DataFrame) -> DataFrame:
    """``gone`` with ``l, r``: ``REACH - 1`` words on each side (at the text's begin what there is), 0 where all of them go anyway."""
    order = Window.partitionBy("uid").orderBy("at")
    gone = gone.withColumn("_f", F.coalesce(F.col("at") > F.lag("at").over(order) + WORDS, F.lit(True)))
    gone = gone.withColumn("_l", F.coalesce(F.lead("at").over(order) > F.col("at") + WORDS, F.lit(True)))
    first = F.max(F.when(F.col("_f"), F.col("at"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.last(F.when(F.col("_l"), F.col("at")), ignorenulls=True).over(Window.partitionBy("uid").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0))
    left = F.least(F.lit(REACH - 1), F.col("at"))
    gone = gone.withColumn("l", F.when(first > F.col("at") - left, left).otherwise(0))
    return gone.withColumn("r", F.when(last < F.col("at") + REACH - 1, F.lit(REACH - 1)).otherwise(0)).drop("_f", "_l")


def common_words(chunk: pd.DataFrame, number: int) -> list[pd.DataFrame]:
    """Answers for rows sorted by ``root, side, words``: ``best`` is the number of first words that a row of an earlier document has too.

    A run of equal first words that holds the chunk's first or last row may go on outside this border (``number`` and ``number + 1``).
    Rows without ``best`` are its earliest document by number of words ``k``. A row that would get more words from such a run has no
    earlier document in it here; it has the border and the most words it shares with it.
    """
    rows, most = len(chunk), REACH - 1
    words = chunk["words"].tolist()
    size = np.fromiter(map(len, words), np.int64, rows) // 4
    marks = np.frombuffer(b"".join(w.ljust(4 * most, b"\0") for w in words), np.uint32).reshape(rows, most)
    group, side = chunk["root"].to_numpy(), chunk["side"].to_numpy()
    differ = np.column_stack([marks[1:] != marks[:-1], np.ones(rows - 1, bool)])
    common = np.minimum(differ.argmax(1), np.minimum(size[1:], size[:-1]))
    common[(group[1:] != group[:-1]) | (side[1:] != side[:-1])] = 0
    order = chunk[["unknown", "doc_id", "uid"]].to_numpy()
    by_order = np.lexsort(order.T[::-1])
    rank = np.empty(rows, np.int64)
    rank[by_order] = np.concatenate([[0], np.cumsum((order[by_order[1:]] != order[by_order[:-1]]).any(1))])
    best = np.zeros(rows, np.int32)
    for k in range(1, most + 1):
        begin = np.concatenate([[0], np.flatnonzero(common < k) + 1])
        if begin.size == rows:
            break
        low = np.minimum.reduceat(rank, begin)
        best[np.repeat(low, np.diff(np.append(begin, rows))) < rank] = k
    ahead = np.minimum.accumulate(np.concatenate([size[:1], common]))
    back = np.minimum.accumulate(np.concatenate([size[-1:], common[::-1]]))[::-1]
    ends = [
        (inside[rank[inside].argmin()], k, words[at][: 4 * k], border)
        for border, at, reach in ((0, 0, ahead), (1, rows - 1, back))
        for k in range(1, int(size[at]) + 1)
        for inside in [np.flatnonzero(reach >= k)]
    ]
    out = [chunk.iloc[best > 0].assign(words=None, best=best[best > 0], k=0, border=0)]
    for border, reach in ((0, ahead), (1, back)):
        asks = np.flatnonzero(reach > best)
        out.append(chunk.iloc[asks].assign(words=None, best=best[asks], k=reach[asks].astype(np.int32), border=number + border))
    least = chunk.iloc[[e[0] for e in ends]]
    out.append(least.assign(best=None, k=[e[1] for e in ends], words=[e[2] for e in ends], border=[number + e[3] for e in ends]))
    return out


def growth(found: DataFrame, gone: DataFrame, classes: DataFrame) -> DataFrame:
    """``uid, at, more_l, more_r``: words beside a paragraph of a cluster that grows which an earlier document of the cluster has too.

    The words beside all paragraphs are sorted, by ranges of even size whatever a cluster's, so that those with equal first words
    follow each other. Chunks of a range give the answers inside; runs that go over the ends of a chunk are settled by joining
    their numbers of words.
    """
    need = gone.groupBy("root").agg(F.max("l").alias("need_l"), F.max("r").alias("need_r")).filter("need_l + need_r > 0")
    wanted = written(classes.join(need, "root"), "growth-classes")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.substring(F.col(words), F.lit(1), 4 * F.col(n)).alias("words")) for k, (n, words) in enumerate((("need_l", "left"), ("need_r", "right")))])
    rows = found.select("uid", "doc_id", "at", "class", "left", "right").join(wanted, "class")
    rows = rows.select("root", "uid", "doc_id", "at", F.explode(sides).alias("s")).filter("octet_length(s.words) > 0")
    unknown = F.col("doc_id").isNull()
    rows = rows.select("root", "s.side", "s.words", unknown.cast("int").alias("unknown"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "uid", "at")
    keys = ["root", "side", "words", "uid"]
    fields = "root long, side int, words binary, unknown int, doc_id long, uid long, at int, best int, k int, border long"

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= CHUNK:
                yield from common_words(pd.concat(held, ignore_index=True), number)
                held, number = [], number + 2
        if sum(map(len, held)):
            yield from common_words(pd.concat(held, ignore_index=True), number)

    met = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(meet, fields), "growth-runs")
    order = F.struct("unknown", "doc_id", "uid")
    ends = met.filter("best IS NULL").select("border", "k", F.xxhash64("root", "side", "k", "words").alias("key"), order.alias("first"))
    ends = ends.join(ends.groupBy("key").agg(F.min("first").alias("least")), "key").filter("least < first")
    ends = ends.groupBy("border").agg(F.collect_list(F.struct("k", "least")).alias("runs"))
    answers = met.filter("best IS NOT NULL")
    asked = answers.filter("k > best").select("uid", "at", "side", "best", "k", "border", order.alias("own")).join(ends, "border")
    more = F.array_max(F.transform(F.filter("runs", lambda r: (r.k <= F.col("k")) & (r.least < F.col("own"))), lambda r: r.k))
    further = asked.select("uid", "at", "side", more.alias("best")).filter("best IS NOT NULL")
    return answers.select("uid", "at", "side", "best").union(further).groupBy("uid", "at").agg(*[
        F.max(F.when(F.col("side") == k, F.col("best"))).alias(name) for k, name in enumerate(("more_l", "more_r"))
    ])


def repeated_spans(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``uid, spans`` (array of word ranges): paragraphs that an earlier document has too. ``docs`` has one row per text."""
    keyed = written(bands_of(docs, text_col), "band-keys")
    shared = written(shared_keys(keyed), "shared-bands")
    candidates = picked(docs, shared.select("uid"), "left_semi")
    found = written(colliding(candidates, shared, id_col, text_col), "colliding")
    roots = components(written(links_of(found, percent, every=False), "paragraph-links"))
    placed = found.select("uid", "doc_id", "at", "class").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    owner = placed.groupBy("root").agg(F.min(document_order()).alias("owner"), F.max(document_order()).alias("last")).filter("owner.uid <> last.uid")
    placed = written(placed.join(owner.select("root", F.col("owner.uid").alias("owner")), "root"), "repeated")
    gone = written(open_sides(placed.filter("uid <> owner").select("uid", "at", "root")), "gone")
    more = written(growth(found, gone, placed.select("class", "root").distinct()), "growth")
    first = (F.col("at") - F.when(F.col("l") > 0, F.coalesce("more_l", F.lit(0))).otherwise(0)).alias("start")
    end = (F.col("at") + WORDS + F.when(F.col("r") > 0, F.coalesce("more_r", F.lit(0))).otherwise(0)).alias("end")
    return gone.join(more, ["uid", "at"], "left").groupBy("uid").agg(F.collect_list(F.struct(first, end)).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_text``."""
    made = {"n_bytes", "n_removed", "n_spans", "kept_text", "uid"}
    keep = [c for c in docs.columns if c not in made]
    rows, copies = split_copies(docs.select(*keep), id_col, text_col)
    unique = picked(rows.select("uid", F.col(id_col), F.col(text_col)), copies, "left_anti")
    spans = written(repeated_spans(unique, percent, id_col, text_col), "spans")
    whole = copies.withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>"))
    marked = written(spans.unionByName(whole), "marked")

    @F.pandas_udf("n_removed long, n_spans long, kept_text string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ranges in batches:
            out = []
            for text, found in zip(texts, ranges):
                raw = (text or "").encode()
                if found is None:  # a copy
                    gone = [(0, len(raw))] if len(raw.split()) >= WORDS else []
                else:
                    start, end = word_bounds(raw)
                    gone = [(int(start[a]), int(end[b - 1])) for a, b in merged((s["start"], s["end"]) for s in found)]
                pieces, at = [], 0
                for a, b in gone:
                    pieces.append(raw[at:a])
                    at = b
                out.append((sum(b - a for a, b in gone), len(gone), (b"".join(pieces) + raw[at:]).decode()))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_text"])

    n_bytes = utf8_bytes(F.col(text_col)).alias("n_bytes")
    untouched = picked(rows, marked.select("uid"), "left_anti").select(
        *keep, n_bytes, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.coalesce(F.col(text_col), F.lit("")).alias("kept_text")
    )
    touched = picked(rows, marked.select("uid"), "left_semi").join(marked, "uid")
    changed = touched.select(*keep, n_bytes, cut(F.col(text_col), F.col("spans")).alias("_c")).select(*keep, "n_bytes", "_c.*")
    return untouched.unionByName(changed)
