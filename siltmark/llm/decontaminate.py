"""Benchmark decontamination by a broadcast hash set of normalised benchmark n-grams. DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words; a benchmark item gives its windows of ``width`` words, a shorter item
its whole sequence as one window. Every window of a document is hashed and looked up in the broadcast set, hits are
verified on the words themselves, and the words inside any hit can be cut out or the document dropped. Documents that hold
the same set of windows share one list of items, which is built once.

The set is broadcast only up to ``most_windows`` windows; a larger one is dealt by hash into parts of that size that are
broadcast one after another, so that the result stays whole.

Defined cases: a NULL text and one without words have no words and no hits; an item without words has no window; NULL item ids
have windows that hit but are no listed item; rows equal in id and text are judged alike, each keeps its row; NULL document ids
are ids like any other; empty tables give no rows (documents) or no hits (benchmark). Input columns named like an output
are replaced, all others stay.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.text import written

WIDTH = 10
#: What stands between words, before and after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIXED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most windows broadcast at once: 10 words of some 10 bytes each make 100 MB.
MOST_WINDOWS = 500_000
MADE = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def item_windows(benchmark: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``item, window, hash``: every window of every item, once per item."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    size = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(size - width + 1, F.lit(1)))
    rows = words.filter(size > 0).select("item", "words", F.explode(starts).alias("at"))
    return rows.select("item", F.slice("words", F.col("at"), F.lit(width)).alias("window")).distinct().withColumn("hash", F.xxhash64("window"))


def window_hits(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """``_id, _digest, words`` against the broadcast ``hash, window``: ``_id, _digest, at, size, hash`` of verified hits."""
    starts = docs.filter(F.size("words") >= min(sizes)).select(
        "*", F.explode(F.sequence(F.lit(1), F.size("words") - min(sizes) + 1)).alias("at")
    )

    def hashed(size: int) -> Column:
        return F.xxhash64(F.slice("words", F.col("at"), F.lit(size)))

    if len(sizes) == 1:
        hashes = starts.withColumn("_hash", hashed(sizes[0]))
    else:  # a window that overhangs the text holds fewer words, so the words tell it apart from a hit
        hashes = starts.withColumn("_hash", F.explode(F.array(*[hashed(s) for s in sizes])))
    same = F.slice("words", F.col("at"), F.size("window")) == F.col("window")
    hits = hashes.join(F.broadcast(windows), (F.col("_hash") == F.col("hash")) & same)
    return hits.select("_id", "_digest", "at", F.size("window").alias("size"), "hash", F.md5(F.concat_ws(" ", "window")).alias("key"))


def merged_spans(hits: Column) -> Column:
    """``(at, size)`` pairs, sorted by start -> disjoint word spans ``(first, last)``, 1-based."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def add(spans: Column, hit: Column) -> Column:
        end = hit["at"] + hit["size"] - 1
        top = F.element_at(spans, -1)
        grown = F.struct(top["first"].alias("first"), F.greatest(top["last"], end).alias("last"))
        new = F.struct(hit["at"].alias("first"), end.alias("last"))
        touches = (F.size(spans) > 0) & (hit["at"] <= F.try_element_at(spans, F.lit(-1))["last"] + 1)
        return F.when(touches, F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(grown))).otherwise(F.concat(spans, F.array(new)))

    return F.aggregate(hits, empty, add)


def _verdicts(docs: DataFrame, benchmark: DataFrame, width: int, id_col: str, text_col: str, item_col: str, item_text: str, most: int) -> DataFrame:
    """``_id, _digest, spans, n_hit, n_items, items_sha256`` of the contaminated documents."""
    items = written(item_windows(benchmark, width, item_col, item_text), "item-windows")
    distinct = items.select("window", "hash").distinct()
    facts = distinct.agg(F.count("*").alias("n"), F.collect_set(F.size("window")).alias("sizes")).first()  # at most ``width`` sizes
    parts = -(-facts["n"] // most) or 1
    keyed = docs.select(F.col(id_col).alias("_id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("_digest"), words_of(F.col(text_col)).alias("words"))
    each = [
        window_hits(keyed, distinct.filter(F.pmod("hash", F.lit(parts)) == part) if parts > 1 else distinct, sorted(facts["sizes"]) or [width])
        for part in range(parts)
    ]
    found = reduce(DataFrame.unionByName, [written(x, "hits") if parts > 1 else x for x in each])
    sets = written(
        found.groupBy("_id", "_digest")
        .agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("hits"), F.sort_array(F.collect_set("key")).alias("keys"))
        .withColumn("class", F.md5(F.concat_ws(",", "keys"))),
        "hit-documents",
    )
    classes = sets.groupBy("class").agg(F.first("keys").alias("keys")).select("class", F.explode("keys").alias("key"))
    named = items.select(F.md5(F.concat_ws(" ", "window")).alias("key"), "item")
    listed = classes.join(named, "key", "left").groupBy("class").agg(F.collect_set("item").alias("items"))
    listed = listed.select("class", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"))
    spans = sets.select("_id", "_digest", "class", merged_spans(F.col("hits")).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return spans.join(listed, "class").select("_id", "_digest", "spans", n_hit.alias("n_hit"), "n_items", "items_sha256")


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items_sha256, contaminated`` and ``spans``, the word spans of hits."""
    verdicts = written(_verdicts(docs, benchmark, width, id_col, text_col, item_col, item_text, most_windows), "contaminated")
    keep = [c for c in docs.columns if c not in MADE]
    rows = docs.select(
        *[F.col(c) if c in keep else F.col(c).alias(f"_in_{c}") for c in dict.fromkeys([*keep, id_col, text_col])],
    )
    named = {c: c if c in keep else f"_in_{c}" for c in (id_col, text_col)}
    rows = rows.select(
        *keep, F.col(named[id_col]).alias("_own"), F.md5(F.coalesce(named[text_col], F.lit(""))).alias("_own_digest"),
        F.size(words_of(F.col(named[text_col]))).cast("long").alias("n_words"),
    )
    out = rows.join(verdicts, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_digest") == F.col("_digest")), "left")
    none = F.sha2(F.lit(""), 256)
    return out.select(
        *keep, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "spans",
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the spans, what stands between their words and what stands before them; NULL spans change nothing."""
    words = F.array_remove(F.split(text, MIXED_GAP), "")
    gaps = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(words)), words, lambda g, w: F.concat(g, w))
    last = F.element_at(gaps, -1)
    starts = F.transform(spans, lambda s: s["first"])
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["last"]))
    until = F.concat(starts, F.array(F.size(words) + 1))
    kept = F.zip_with(ends, until, lambda a, b: F.array_join(F.slice(pieces, a + 1, b - a - 1), ""))
    return F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), last))


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated spans (``remove="spans"``) or without the contaminated documents (``"documents"``)."""
    clash = [c for c in docs.columns if c in MADE]
    inner = docs.select("*", *[F.col(c).alias(f"_kept_{c}") for c in clash])
    judged = contamination(inner, benchmark, text_col=text_col, **options)
    if remove == "documents":
        judged = judged.filter(~F.col("contaminated"))
    else:
        judged = judged.withColumn(text_col, without_spans(F.col(text_col), F.col("spans")))
    return judged.select(*[F.col(f"_kept_{c}").alias(c) if c in clash else F.col(c) for c in docs.columns])
