"""Cross-tokenizer alignment over inverted pair bitmaps.

Two vocabularies cut the same bytes: A, a byte-level BPE, encodes a space and the text, B, a piece model, adds that space itself.
Byte offsets where tokens of both end cut the text into groups; a link is a pair of occurrences whose bytes overlap.

Neither vocabulary joins a character to the space after it, so texts are cut there; each distinct fragment is
encoded and aligned once per worker (bounded memo). Documents are numbered in blocks. For each block and bucket of pairs
one row holds an inverted index: for each pair of ids compressed bitmaps of the documents that link it, one per bit of
the number of links (multiplicity planes; sparse bitmaps as lists, dense ones as bits). Planes are OR-merged and popcounted for
document counts, and weighted by their bit for link counts; counts are summed over blocks by Spark. The postings then
meet the counts by cogroup per bucket and group of blocks and return each document's scores, which are added per block. A
frequent pair has a bitmap in every block, so no group grows with it.

Defined cases: NULL and empty texts, and texts whose joined token bytes differ from space and text (such as a literal
U+2581), have no tokens: zeros and the empty string. Strings of special tokens are plain text. Rows equal in id and text are
different documents with equal results; a NULL id stays NULL; empty tables give no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.bpe import PIECES, byte_letters
from siltmark.llm.text import written

#: Certain cuts; texts that have white space before a space or at their end take them one by one, others simply at spaces.
CUT = re.compile(r"(?<=\S)(?= )")
ODD = re.compile(r"[^\S ](?: |\Z)")
BLOCK = 4096
#: A block is also closed at so many characters, the memo of fragments at so many entries and characters.
BLOCK_CHARS = 4_000_000
MEMO, MEMO_CHARS = 400_000, 16_000_000
#: Fragments encoded in one call, and documents whose fragments are learnt together.
TOGETHER, DOCS = 4_000, 100
#: Words looked up at once, so that one long text doesn't outgrow the memo.
WORDS = 50_000
BUCKETS = 16
#: Blocks whose postings of one bucket meet the counts together.
GROUP_BLOCKS = 32
#: Bitmaps of as many documents are kept as bits, others as lists.
DENSE = BLOCK // 16

INDEX = "kind int, block long, bucket int, pairs binary, planes array<binary>, at int, id long, known boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
COLUMNS = [f.split()[0] for f in INDEX.split(", ")]
SCORES = "block long, at binary, count_sum binary, n_best binary"
OUT = "id long, known boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """Both encoders and the memo of aligned fragments; built once per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        self.bytes_a = {i: token for token, i in vocab.items()}
        results = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        in_order = results == sorted(results) and len(vocab) == 256 + len(results)
        self.encode_a = self._ranked(vocab) if in_order else self._library(path_a)
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(i) for i in range(self.model_b.get_piece_size())]
        self.space_b = self.model_b.piece_to_id("▁")
        if any(re.search("[^▁]▁", self.model_b.id_to_piece(i)) for i in range(len(self.bytes_b))):
            raise ValueError(f"{path_b} has pieces that join a character to the space after it")
        self.lossless = in_order  # bytes are tokens and nothing else changes them
        most = max(self.bytes_a) + 1
        self.len_a = np.asarray([len(self.bytes_a.get(i, b"")) for i in range(most)])
        self.len_b = np.asarray([len(x) for x in self.bytes_b])
        self.text_a = np.asarray([[f"{i}{end}" for i in range(most)] for end in ",|"], object)
        self.text_b = np.asarray([[f"{i}{end}" for i in range(len(self.bytes_b))] for end in ",;\n"], object)
        self.clear()

    @staticmethod
    def _ranked(vocab: dict[bytes, int]):
        """Ids follow the order of merges, so that tiktoken's ranks give the same tokens."""
        import tiktoken

        return tiktoken.Encoding("byte-level", pat_str=PIECES, mergeable_ranks=vocab, special_tokens={}).encode_ordinary

    @staticmethod
    def _library(path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, i: int) -> bytes:
        piece = self.model_b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.model_b.is_byte(i) else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.groups: list[str] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.chars = 0

    @property
    def full(self) -> bool:
        return len(self.groups) >= MEMO or self.chars >= MEMO_CHARS

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and B, groups and links of every entry, and all their links one after another."""
        if len(self.parts) > 1:
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts))]
        return self.parts[0] if self.parts else (np.zeros((0, 4), np.int64), np.zeros(0, np.int64))

    def _align(self, fragments: list[str], a: list[int], b: list[int]) -> int | None:
        """Add the fragments, whose tokens one after another are given, and return the first entry.

        Adds none and returns None where the tokens don't hold the bytes or reach over an end of a fragment.
        """
        raws = [f.encode() for f in fragments]
        raw = b"".join(raws)
        if b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        ids_a, ids_b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        if ends_a[-1] != len(raw) or (not self.lossless and b"".join([self.bytes_a[i] for i in a]) != raw):
            return None
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last = np.searchsorted(ends, common)
        if ends[-1] != common[-1] or len(ends) != np.count_nonzero(ends[last] == common):
            return None
        cuts = np.union1d(ends_a, ends_b)  # each stretch between two ends is one link
        links = ids_a[np.searchsorted(ends_a, cuts)] << 32 | ids_b[np.searchsorted(ends_b, cuts)]
        counts = [np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (ends_a, ends_b, common, cuts)]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        closes_b = (common[group_b] == ends_b).astype(int)
        closes_b += closes_b * (ends[last] == common)[group_b]
        texts = np.empty(len(a) + len(b), object)
        texts[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = self.text_a[(common[group_a] == ends_a).astype(int), ids_a]
        texts[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.text_b[closes_b, ids_b]
        self.groups += "".join(texts.tolist())[:-1].split("\n")
        self.parts.append((np.stack(counts, axis=1), links))
        self.chars += 2 * len(raw)
        return len(self.groups) - len(fragments)

    def keys(self, text: str) -> list[str]:
        """Memo keys of the fragments of a space and the text: what follows the one space, or the fragment itself."""
        words = text.split(" ")
        if "" in words or ODD.search(text):
            fragments = CUT.split(" " + text)
            words = [f[1:] if len(f) > 1 and f[1] != " " and not f[-1].isspace() else f for f in fragments]
        return words

    def learn(self, keys: list[str]) -> None:
        """Add the keys to the memo, plain ones together: they are cut from each other for certain."""
        memo = self.memo
        plain = [k for k in keys if k[:1] != " "]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            text = " ".join(some)
            first = self._align([" " + k for k in some], self.encode_a(" " + text), self.model_b.encode(text))
            if first is None:
                memo.update((k, self.whole(k)) for k in some)
            else:
                memo.update(zip(some, range(first, first + len(some))))
        for key in keys:
            if key[:1] == " ":
                b = [self.space_b] if key == " " else self.model_b.encode(key[1:])
                found = self._align([key], self.encode_a(key), b)
                memo[key] = -1 if found is None else found

    def entries(self, keys: list[str]) -> np.ndarray:
        """Memo entries of the keys, -1 where the tokens don't hold the bytes."""
        try:
            return np.fromiter(map(self.memo.__getitem__, keys), np.int64, len(keys))
        except KeyError:
            self.learn([k for k in set(keys) if k not in self.memo])
            return np.fromiter(map(self.memo.__getitem__, keys), np.int64, len(keys))

    def whole(self, text: str) -> int:
        """The entry of a text that is judged as one fragment, -1 if it has no tokens."""
        found = self._align([" " + text], self.encode_a(" " + text), self.model_b.encode(text))
        return -1 if found is None else found


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def summed(pairs: np.ndarray, at: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per pair and document, sorted by both."""
    names = np.unique(pairs)
    key = np.searchsorted(names, pairs) * BLOCK + at
    order = np.argsort(key)
    key, links = key[order], links[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    first = key[starts]
    return names[first // BLOCK], first % BLOCK, np.add.reduceat(links, starts) if len(starts) else links


def bitmap_plane(pair: np.ndarray, at: np.ndarray, n_pairs: int) -> bytes:
    """Documents of each pair (sorted numbers): how many, lists of the sparse ones, then bits of the dense ones."""
    counts = np.bincount(pair, minlength=n_pairs).astype("<i4")
    dense = counts >= DENSE
    inside = dense[pair]
    bits = np.zeros((int(dense.sum()), BLOCK), bool)
    bits[(np.cumsum(dense) - 1)[pair[inside]], at[inside]] = True
    return counts.tobytes() + at[~inside].astype("<u2").tobytes() + np.packbits(bits, axis=1).tobytes()


def plane_counts(plane: bytes, n_pairs: int) -> np.ndarray:
    return np.frombuffer(plane, "<i4", n_pairs).astype(np.int64)


def plane_entries(plane: bytes, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """The pair number and document of every bit that is set."""
    counts = np.frombuffer(plane, "<i4", n_pairs)
    dense = counts >= DENSE
    numbers = np.arange(n_pairs)
    sparse = np.frombuffer(plane, "<u2", int(counts[~dense].sum()), 4 * n_pairs)
    bits = np.frombuffer(plane, np.uint8, -1, 4 * n_pairs + 2 * len(sparse)).reshape(int(dense.sum()), BLOCK // 8)
    row, at = np.nonzero(np.unpackbits(bits, axis=1))
    return np.append(np.repeat(numbers[~dense], counts[~dense]), numbers[dense][row]), np.append(sparse.astype(np.int64), at)


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    return ((pairs >> 32) * 7919 + (pairs & 0xFFFFFFFF)) % BUCKETS


class Block:
    """Documents of a block and the links between their tokens."""

    def __init__(self, work: Aligner):
        self.work = work
        self.at: list[np.ndarray] = []
        self.pending: list[np.ndarray] = []
        self.parts: list[tuple] = []
        self.rows: list[tuple] = []
        self.counts = np.zeros((BLOCK, 4), np.int64)
        self.chars = 0

    def reduce(self) -> None:
        """Turn the pending memo entries into links per pair and document; afterwards the memo may be cleared."""
        work = self.work
        if self.pending:
            entry, at = np.concatenate(self.pending), np.concatenate(self.at)
            table, links = work.table()
            np.add.at(self.counts, at, table[entry])
            used, times = np.unique(entry * BLOCK + at, return_counts=True)
            entry, at = used // BLOCK, used % BLOCK
            starts, many = (np.cumsum(table[:, 3]) - table[:, 3])[entry], table[entry, 3]
            spread = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            self.parts.append(summed(links[spread], np.repeat(at, many), np.repeat(times, many)))
            self.at, self.pending = [], []
        if work.full:
            work.clear()

    def add(self, doc_id: int, known: bool, text: str | None, keys: list[str]) -> None:
        n, work = len(self.rows), self.work
        digest, found = hashlib.sha256(), False
        chunks = [keys[k : k + WORDS] for k in range(0, len(keys), WORDS)]
        if len(chunks) > 1:
            for chunk in chunks:
                if work.full:
                    self.reduce()
                if work.entries(chunk).min() < 0:
                    chunks = [[]]
                    break
        for k, chunk in enumerate(chunks):
            if work.full and len(chunks) > 1:
                self.reduce()
            entry = work.entries(chunk)
            if not len(entry) or entry.min() < 0:
                entry = np.asarray([work.whole(text)])
                if entry[0] < 0:
                    break
            found = True
            self.pending.append(entry)
            self.at.append(np.full(len(entry), n))
            digest.update(((";" if k else "") + ";".join([work.groups[e] for e in entry.tolist()])).encode())
        self.rows.append((doc_id, known, digest.hexdigest() if found else ""))
        self.chars += len(text or "")

    @property
    def full(self) -> bool:
        return len(self.rows) >= BLOCK or self.chars >= BLOCK_CHARS

    def frame(self, number: int) -> pd.DataFrame:
        """Rows of the index (kind 0) and of the documents (kind 1)."""
        self.reduce()
        parts = [np.concatenate(x) for x in zip(*self.parts)] if self.parts else [np.zeros(0, np.int64)] * 3
        pairs, at, links = summed(*parts) if len(self.parts) != 1 else parts
        bucket, out = bucket_of(pairs), []
        for b in range(BUCKETS):
            mine = bucket == b
            if mine.any():
                names, which = np.unique(pairs[mine], return_inverse=True)
                docs, times = at[mine], links[mine]
                planes = [(times >> j) & 1 == 1 for j in range(int(times.max()).bit_length())]
                out.append((0, number, b, names.astype("<i8").tobytes(), [bitmap_plane(which[p], docs[p], len(names)) for p in planes], *[None] * 8))
        for k, (row, c) in enumerate(zip(self.rows, self.counts.tolist())):
            out.append((1, number, None, None, None, k, row[0], row[1], *c, row[2]))
        columns = dict(zip(COLUMNS, zip(*out)))
        whole = {"bucket": "Int32", "at": "Int32", "id": "Int64", "known": "boolean", **{c: "Int64" for c in ("n_a", "n_b", "n_groups", "n_links")}}
        return pd.DataFrame({c: pd.array(v, dtype=whole[c]) if c in whole else pd.Series(v, dtype="int64" if c in ("kind", "block") else object) for c, v in columns.items()})


def pair_index(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``_id, _known, _text`` -> the written rows of index and documents."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        work = aligner(path_a, path_b)
        work.clear()
        block = Block(work)
        for batch in batches:
            rows = list(zip(batch["_id"].tolist(), batch["_known"].tolist(), batch["_text"].tolist()))
            while rows:
                some, rows = rows[:DOCS], rows[DOCS:]
                keys = [work.keys(text) if text else [] for _, _, text in some]
                if work.full:
                    block.reduce()
                missing = set().union(*[k for k in keys if len(k) <= WORDS]).difference(work.memo)
                work.learn(list(missing))
                for row, k in zip(some, keys):
                    block.add(*row, k)
                    if block.full:
                        yield block.frame(number)
                        number, block = number + 1, Block(work)
        if block.rows:
            yield block.frame(number)

    return written(docs.mapInPandas(index, INDEX), "pair-index")


def pair_counts(index: DataFrame) -> DataFrame:
    """``a, b, bucket, n_docs, n_links`` of every pair of ids: planes OR-merged and popcounted, and popcounted by weight."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, n_docs, n_links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for raw, planes in zip(batch["pairs"], batch["planes"]):
                pairs = np.frombuffer(raw, "<i8")
                set_bits = [pair * BLOCK + at for pair, at in (plane_entries(p, len(pairs)) for p in planes)]
                merged = set_bits[0] if len(set_bits) == 1 else np.unique(np.concatenate(set_bits))
                names.append(pairs)
                n_docs.append(np.bincount(merged // BLOCK, minlength=len(pairs)))
                n_links.append(sum(plane_counts(p, len(pairs)) << j for j, p in enumerate(planes)))
            pairs, which = np.unique(np.concatenate(names), return_inverse=True)
            sums = [np.zeros(len(pairs), np.int64) for _ in range(2)]
            for total, values in zip(sums, (n_docs, n_links)):
                np.add.at(total, which, np.concatenate(values))
            yield pd.DataFrame({"a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "bucket": bucket_of(pairs), "n_docs": sums[0], "n_links": sums[1]})

    rows = index.filter("kind = 0").select("pairs", "planes").mapInPandas(count, "a int, b int, bucket int, n_docs long, n_links long")
    return rows.groupBy("a", "b", "bucket").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def returned_scores(postings: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Each block's documents with the links of this bucket's pairs: their counts summed, and how many are the best of their B id."""
    known = (counts["a"].to_numpy(np.int64) << 32) | counts["b"].to_numpy(np.int64)
    order = np.argsort(known)
    known, links, best = known[order], counts["n_links"].to_numpy(np.int64)[order], counts["best"].to_numpy(bool)[order]
    out = []
    for block, raw, planes in zip(postings["block"], postings["pairs"], postings["planes"]):
        pairs = np.frombuffer(raw, "<i8")
        here = np.searchsorted(known, pairs)
        count_sum, n_best = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
        for j, plane in enumerate(planes):
            pair, at = plane_entries(plane, len(pairs))
            np.add.at(count_sum, at, links[here[pair]] << j)
            np.add.at(n_best, at, best[here[pair]].astype(np.int64) << j)
        used = np.flatnonzero(count_sum)
        out.append((block, used.astype("<u2").tobytes(), count_sum[used].tobytes(), n_best[used].astype("<i4").tobytes()))
    return pd.DataFrame(out, columns=[f.split()[0] for f in SCORES.split(", ")])


def with_scores(docs: pd.DataFrame, scores: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block with the sums of what the buckets returned."""
    count_sum, n_best = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    for at, counts, best in zip(scores["at"], scores["count_sum"], scores["n_best"]):
        here = np.frombuffer(at, "<u2")
        count_sum[here] += np.frombuffer(counts, "<i8")
        n_best[here] += np.frombuffer(best, "<i4")
    at = docs["at"].to_numpy(np.int64)
    return docs.assign(n_best=n_best[at], count_sum=count_sum[at])[[f.split()[0] for f in OUT.split(", ")]]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    number = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(number, F.lit(0)).alias("_id"), number.isNotNull().alias("_known"), F.col(text_col).alias("_text"))
    index = pair_index(rows, path_a, path_b)
    counts = written(pair_counts(index), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n_links").alias("_most"))
    judged = counts.join(highest, "b").select("a", "b", "bucket", "n_links", (F.col("n_links") == F.col("_most")).alias("best"))
    groups = -(-index.filter("kind = 1 AND at = 0").count() // GROUP_BLOCKS) or 1
    postings = index.filter("kind = 0").select("bucket", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("part"), "block", "pairs", "planes")
    spread = judged.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    scores = postings.groupBy("bucket", "part").cogroup(spread.groupBy("bucket", "part")).applyInPandas(returned_scores, SCORES)
    rows = index.filter("kind = 1").select("block", "at", "id", "known", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = rows.groupBy("block").cogroup(scores.groupBy("block")).applyInPandas(with_scores, OUT)
    result = F.when(F.col("known"), F.col("id")).alias(id_col)
    return out.select(result, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
