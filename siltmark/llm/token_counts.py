"""Token counts of huge texts by overlapping chunks and resynchronisation.

A text longer than a chunk is encoded in overlapping chunks with offsets. Two neighbours are spliced at a
boundary both encodings have and that is stable by proof: white space stands before it, which the
vocabulary's pattern never joins to a token, and no combining mark follows it, so normalisation on one side
doesn't reach over it. The tokens after it must agree up to the end of the overlap's last stable boundary.
Where an overlap holds no such boundary it is widened, up to the rest of the text. Shorter texts are cut at all their stable
boundaries, and each distinct fragment is counted once per worker.

Defined cases: NULL is the empty text with 0 tokens; strings of special tokens count as the library does by
default; a text without any white space ends as one chunk; repeated rows give equal counts; an empty table gives no
rows; input columns named like an output are replaced.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.text import utf8_bytes

CHUNK = 16384
OVERLAP = 256
#: White space at which the pattern always splits.
STABLE = " \t\n\r"
CUTS = str.maketrans(dict.fromkeys(STABLE, " "))
#: Most fragments remembered by a worker, fragments encoded in one call, and a count that shows in any sum.
MEMO, TOGETHER, SPOILT = 400_000, 4_000, -(1 << 50)


@lru_cache(maxsize=4)
def counter(path: str):
    """The library's encoder of a .json or .model file as ``encode(list of texts) -> list of [(start, end)]``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def pieces(texts: list[str]) -> list[list[tuple[int, int]]]:
            return [[(p.begin, p.end) for p in model.encode(t, out_type="immutable_proto").pieces] for t in texts]

        return pieces
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda texts: [e.offsets for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def lengths(path: str):
    """Numbers of tokens without offsets, for texts of one chunk."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    fast = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    return lambda texts: [len(e) for e in fast(texts, add_special_tokens=False)]


class FragmentCounts:
    """Token numbers of texts from those of their fragments between stable boundaries; each distinct fragment is encoded once.

    For vocabularies with word ends, whose pattern never joins white space to a token. The memo holds at most ``MEMO`` fragments.
    """

    def __init__(self, path: str):
        self.encode, self.short = counter(path), lengths(path)
        self.memo: dict[str, int] = {"": 0}

    def learn(self, words: list[str]) -> None:
        """Count all words in one text: a token belongs to the word its start lies in. Words after which or in which a cut is not
        certain (a combining mark at the start) get a number that spoils any sum."""
        spoilt = [w for w in words if unicodedata.combining(w[0])]
        whole = [w for w in words if not unicodedata.combining(w[0])]
        self.memo.update(dict.fromkeys(spoilt, SPOILT))
        for at in range(0, len(whole), TOGETHER):
            some = whole[at : at + TOGETHER]
            sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
            starts = np.cumsum(sizes) - sizes
            spans = self.encode([" ".join(some)])[0]
            first = np.fromiter((a for a, _ in spans), np.int64, len(spans))
            counts = np.bincount(np.searchsorted(starts, first, "right") - 1, minlength=len(some))
            self.memo.update(zip(some, counts.tolist()))

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [t.translate(CUTS).split(" ") for t in texts]
        missing = set().union(*cut).difference(self.memo)
        if len(missing) > MEMO // 2 and len(texts) > 1:
            middle = len(texts) // 2
            return self(texts[:middle]) + self(texts[middle:])
        if len(self.memo) + len(missing) > MEMO:
            self.memo = {"": 0}
            missing = set().union(*cut).difference(self.memo)
        self.learn(list(missing))
        memo = self.memo
        out = [sum(map(memo.__getitem__, words)) for words in cut]
        odd = [k for k, n in enumerate(out) if n < 0]
        for k, n in zip(odd, self.short([texts[k] for k in odd]) if odd else ()):
            out[k] = n
        return out


@lru_cache(maxsize=4)
def plain_counts(path: str):
    """Counts of texts of one chunk: by fragments where the vocabulary has word ends, else by the library."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            if json.load(f)["model"].get("end_of_word_suffix"):
                return FragmentCounts(path)
    return lengths(path)


def stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at - 1] in STABLE and text[at] not in STABLE and not unicodedata.combining(text[at])


def splice(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], low: int, high: int) -> int | None:
    """A stable boundary in [low, high) where both encodings start a token and agree from there to the last such boundary."""
    starts = {a for a, _ in right if low <= a < high}
    common = [a for a, _ in left if a in starts and stable(text, a)]
    if len(common) < 2:
        return None
    first, last = common[0], common[-1]
    mine = [x for x in left if first <= x[0] < last]
    return first if mine == [x for x in right if first <= x[0] < last] else None


def count_tokens(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text, from chunks that overlap by ``overlap`` or more characters."""
    if len(text) <= chunk:
        return len(encode([text])[0])
    start, total, wide = 0, 0, overlap
    size = chunk
    offsets = encode([text[:size]])[0]
    while start + size < len(text):
        end = start + size
        begin = max(start + 1, end - wide)
        longer = text[begin : begin + chunk + wide]
        right = [(a + begin, b + begin) for a, b in encode([longer])[0]]
        left = [(a + start, b + start) for a, b in offsets]
        at = splice(text, left, right, begin, end)
        if at is None:
            if begin + len(longer) >= len(text) and begin == start + 1:  # nothing left to widen: one chunk
                return total + len(encode([text[start:]])[0])
            wide *= 2
            if wide >= size:  # the chunk itself is too short to hold a boundary
                size *= 2
                offsets = encode([text[start : start + size]])[0]
            continue
        total += sum(a < at for a, _ in left)
        offsets = [(a - at, b - at) for a, b in right if a >= at]
        start, size, wide = at, begin + len(longer) - at, overlap
    return total + len(offsets)


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, text_col: str = "text"
) -> DataFrame:
    """``docs`` with ``n_bytes, n_tokens, over_limit``."""
    made = {"n_bytes", "n_tokens", "over_limit"}
    keep = [c for c in docs.columns if c not in made]

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, short = counter(vocabulary), plain_counts(vocabulary)
        for texts in batches:
            values = [t or "" for t in texts]
            out = [0] * len(values)
            few = [k for k, t in enumerate(values) if len(t) <= chunk]
            for at in range(0, len(few), 256):
                group = few[at : at + 256]
                for k, n in zip(group, short([values[k] for k in group])):
                    out[k] = n
            for k, t in enumerate(values):
                if len(t) > chunk:
                    out[k] = count_tokens(t, encode, chunk, overlap)
            yield pd.Series(out, dtype="int64")

    counted = docs.select(*keep, utf8_bytes(F.col(text_col)).alias("n_bytes"), count(F.col(text_col)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
