"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners by hash. Documents are indexed in blocks; for each block and owner there is one row of postings.
A bundle of items starts with empty accumulators for every block and passes through the owners one stage after another:
at each stage it meets the owner's postings of its block by cogroup, adds the integer contributions of that owner's terms to
its sparse document accumulators, and goes on. After the last stage each bundle names its best documents of the block,
and a grouped limit picks the winners over all blocks. A frequent term is spread over all blocks, so no group holds
more than a block's postings and a bundle's accumulators.

The items' vocabulary filters postings inside the indexing tasks; it is bounded by ``most_terms`` item terms, more items are
searched in several rounds by hash, so that results stay whole.

Scores: ``sum over the item's terms, repeats included, of w * ((10^9 * tf) div (1000 * tf + 8 * m))`` with
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` and ``m = 25 + (75 * n * N) div L``, 64-bit integers but for the logarithm.

Defined cases: NULL texts have no terms and match nothing; rows equal in id and text are different documents; a NULL
document id ranks behind all others of its score; items equal in id and text are one item; a NULL item id is an id; items of
one id but different texts are searched apart, each with its own ranks; items without terms or hits give no rows; empty
tables give no rows; other columns of the inputs are not used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.text import written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
OWNERS = 4
BLOCK = 4096
#: A block is also closed at so many postings.
BLOCK_POSTINGS = 1_000_000
#: Items of one bundle: its accumulators are at most ITEMS x BLOCK x 8 bytes in a task.
ITEMS = 256
MOST_TERMS = 1_000_000

INDEX = "kind int, block long, owner int, ids binary, known binary, lengths binary, at binary, term binary, tf binary, term_id int, df long, n_docs long, n_terms long"
BUNDLES = "bundle int, block long, keys binary, scores binary"
HITS = "item int, _doc long, known boolean, score long"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(LOWER)) if text else []


def indexed(docs: DataFrame, vocabulary: dict[str, int], owners: int, block: int) -> DataFrame:
    """The index of the vocabulary's terms: a row per block and owner (kind 0), df per block and term (kind 1), sizes (kind 2)."""
    columns = [f.split()[0] for f in INDEX.split(", ")]

    def rows_of(number: int, ids: list, known: list, lengths: list, at: list, term: list, tf: list) -> pd.DataFrame:
        ids_, known_ = np.asarray(ids, "<i8"), np.asarray(known, bool)
        at_, term_, tf_ = np.asarray(at, "<i4"), np.asarray(term, "<i4"), np.asarray(tf, "<i8")
        order = np.lexsort((at_, term_))
        at_, term_, tf_ = at_[order], term_[order], tf_[order]
        lengths_ = np.asarray(lengths, "<i8")
        out = [
            (0, number, o, ids_.tobytes(), known_.tobytes(), lengths_.tobytes(), at_[mine].tobytes(), term_[mine].tobytes(), tf_[mine].tobytes(), None, None, None, None)
            for o in range(owners)
            for mine in [term_ % owners == o]
        ]
        empty = (None,) * 7
        out += [(1, number, *empty, t, n, None, None) for t, n in zip(*(x.tolist() for x in np.unique(term_, return_counts=True)))]
        out.append((2, number, *empty, None, None, int((lengths_ > 0).sum()), int(lengths_.sum())))
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({"owner": "Int32", "term_id": "Int32", "df": "Int64", "n_docs": "Int64", "n_terms": "Int64"})

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids, known, lengths, at, term, tf = [], [], [], [], [], []
        for batch in batches:
            for i, has, text in zip(batch["_id"].tolist(), batch["_known"].tolist(), batch["_text"].tolist()):
                words = terms_of(text)
                for word, n in Counter(words).items():
                    t = vocabulary.get(word)
                    if t is not None:
                        at.append(len(ids))
                        term.append(t)
                        tf.append(n)
                ids.append(i)
                known.append(has)
                lengths.append(len(words))
                if len(ids) >= block or len(at) >= BLOCK_POSTINGS:
                    yield rows_of(number, ids, known, lengths, at, term, tf)
                    number += 1
                    ids, known, lengths, at, term, tf = [], [], [], [], [], []
        if ids:
            yield rows_of(number, ids, known, lengths, at, term, tf)

    return docs.mapInPandas(index, INDEX)


def winners(bundle: int, scores: np.ndarray, row: pd.Series, top: int) -> list[tuple]:
    """The best documents of a block for every item of a bundle, ties by document id."""
    ids, known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], bool)
    item, at = np.nonzero(scores)
    values = scores[item, at]
    order = np.lexsort((ids[at], ~known[at], -values, item))
    item, at, values = item[order], at[order], values[order]
    best = np.arange(len(item)) - np.searchsorted(item, item) < top
    item, at, values = item[best] + bundle * ITEMS, at[best], values[best]
    return list(zip(item.tolist(), ids[at].tolist(), known[at].tolist(), values.tolist()))


def stage(terms: dict[int, tuple[np.ndarray, np.ndarray, int]], sizes: tuple[int, int], top: int = 0):
    """One owner's visit, the last one if it is given the ``top`` to name.

    ``terms``: term -> items that ask for it, how often each, and the term's weight; ``sizes``: N and L.
    """
    columns = [f.split()[0] for f in (HITS if top else BUNDLES).split(", ")]

    def visit(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        out = []
        if bundles.empty or postings.empty:
            return pd.DataFrame(columns=columns)
        row = postings.iloc[0]
        lengths = np.frombuffer(row["lengths"], "<i8")
        at, term, tf = np.frombuffer(row["at"], "<i4"), np.frombuffer(row["term"], "<i4"), np.frombuffer(row["tf"], "<i8")
        n, total = sizes
        m = 25 + (75 * lengths * n) // max(total, 1)
        part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
        names, starts = np.unique(term, return_index=True)
        ends = np.append(starts[1:], len(term))
        for bundle, block, known_keys, known_scores in bundles.itertuples(index=False):
            scores = np.zeros((ITEMS, len(lengths)), np.int64)
            if known_keys:
                scores.reshape(-1)[np.frombuffer(known_keys, "<i4")] = np.frombuffer(known_scores, "<i8")
            low = bundle * ITEMS
            for t, s, e in zip(names.tolist(), starts.tolist(), ends.tolist()):
                items, often, weight = terms[t]
                for k in range(*np.searchsorted(items, [low, low + ITEMS]).tolist()):
                    scores[items[k] - low, at[s:e]] += int(often[k]) * weight * part[s:e]
            if top:
                out += winners(bundle, scores, row, top)
            else:
                keys = np.flatnonzero(scores)
                out.append((bundle, block, keys.astype("<i4").tobytes(), scores.reshape(-1)[keys].tobytes()))
        return pd.DataFrame(out, columns=columns)

    return visit


def _search(docs: DataFrame, items: DataFrame, top: int, owners: int, block: int) -> DataFrame:
    """One round: ``items`` (``item_id, text``, distinct) whose terms fit the bound -> ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    asked = items.collect()  # at most MOST_TERMS terms by the caller's count
    wanted = [Counter(terms_of(r["text"])) for r in asked]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*wanted)))}
    id_type = items.schema["item_id"].dataType.simpleString()
    named = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(asked)], f"item int, item_id {id_type}")
    if not vocabulary:
        return spark.createDataFrame([], f"item int, {HITS}, item_id {id_type}".replace("item int, item int", "item int"))
    index = written(indexed(docs, vocabulary, owners, block), "term-index")
    sizes = index.filter("kind = 2").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    n, total = sizes["n"] or 0, sizes["total"] or 0
    df = {r["term_id"]: r["df"] for r in index.filter("kind = 1").groupBy("term_id").agg(F.sum("df").alias("df")).collect()}
    by_term: dict[int, tuple[list, list]] = {}
    for k, counts in enumerate(wanted):
        for word, often in counts.items():
            here = by_term.setdefault(vocabulary[word], ([], []))
            here[0].append(k)
            here[1].append(often)
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    by_owner = [
        {t: (np.asarray(a), np.asarray(b), weights[t]) for t, (a, b) in by_term.items() if t in weights and t % owners == o} for o in range(owners)
    ]
    n_bundles = -(-len(asked) // ITEMS)
    postings = index.filter("kind = 0").select("block", "owner", "lengths", "ids", "known", "at", "term", "tf")
    each = F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle")
    blank = F.lit(None).cast("binary")
    bundles = index.filter("kind = 2").select(each, "block", blank.alias("keys"), blank.alias("scores"))
    for o in range(owners):
        last = o == owners - 1
        owned = postings.filter(F.col("owner") == o).select(each, *postings.columns)
        visit = stage(by_owner[o], (n, total), top if last else 0)
        bundles = bundles.groupBy("bundle", "block").cogroup(owned.groupBy("bundle", "block")).applyInPandas(visit, HITS if last else BUNDLES)
    return bundles.join(F.broadcast(named), "item")


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = 10, owners: int = OWNERS, block: int = BLOCK, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_terms: int = MOST_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every item."""
    number = F.col(id_col).cast("long")
    pairs = docs.select(F.coalesce(number, F.lit(0)).alias("_id"), number.isNotNull().alias("_known"), F.col(text_col).alias("_text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text") / 2 + 1).alias("n")).first()["n"] or 0  # terms a text can hold at most
    rounds = max(1, math.ceil(size / most_terms))
    parts = [asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r) if rounds > 1 else asked for r in range(rounds)]
    found = [_search(pairs, part, top, owners, block).withColumn("_round", F.lit(r)) for r, part in enumerate(parts)]
    hits = reduce(DataFrame.unionByName, [written(f, "hits") for f in found] if rounds > 1 else found)
    best = Window.partitionBy("_round", "item").orderBy(F.col("score").desc(), F.col("known").desc(), "_doc")
    ranked = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", F.when(F.col("known"), F.col("_doc")).alias("doc_id"), "score")
