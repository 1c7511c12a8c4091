"""Byte-level BPE by forced boundaries.

A byte pair that occurs inside no token of the vocabulary is a certain cut: no token can span it.
Texts are cut at certain pairs first, fragments are encoded one by one (equal fragments once per
task, in a bounded cache) and the results are concatenated. Inside a fragment the byte-level pattern splits
pieces, pieces are cut again at certain pairs, and ranked merges finish each part.

The first cut takes only certain pairs of a character that is no white space and one that is: there
the pattern ends a piece whatever follows, so the fragments split as the whole text does.

Defined cases: NULL is the empty text and gives no ids; strings of added tokens inside a text become those tokens,
as the tokenizers library does by default; texts have no length bound; repeated rows give equal results;
an empty table gives no rows; input columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.llm.text import BATCH_ROWS

#: The byte-level pre-tokenizer's pattern and the white space of Unicode.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_WHITE = b"\t\n\x0b\x0c\r "
RARE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
#: Bytes of fragments and ids that a worker remembers, counted with some 200 for the objects that hold them.
CACHED = 128 << 20
LONG = 256


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file; built once per Python worker."""

    def __init__(self, path: str, cached: int = CACHED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        self.pairs = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(merges)}
        self.results = [vocab[a + b] for a, b in merges]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.tokens = {i: b for b, i in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: s.encode() for s, i in self.added.items()}
        inside = np.zeros((256, 256), bool)
        for token in self.ids:
            inside[list(token[:-1]), list(token[1:])] = True
        self.certain = ~inside
        self.cut_pairs = self.certain.tobytes()
        self.cached, self.cache, self.cache_bytes = cached, {}, 0
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern[bytes]:
        """The pattern of fragments: they end at certain pairs of a non-space's last byte and a white-space byte.

        White space of Unicode beyond ASCII may stand before the white-space byte, where the byte-level pattern
        doesn't split for sure; texts that hold such are one fragment (``RARE``).
        """
        ends = [b for b in range(256) if b < 0xC0 and b not in ASCII_WHITE]
        joined = {b for b in ends for w in ASCII_WHITE if not self.certain[b, w]}
        white = b"[" + re.escape(ASCII_WHITE) + b"]"
        other = b"[^" + re.escape(ASCII_WHITE) + b"]"
        more = b"(?:(?<=[" + re.escape(bytes(sorted(joined))) + b"])" + white + b"+" + other + b"+)*" if joined else b""
        return re.compile(white + b"*" + other + b"+" + more + b"|" + white + b"+")

    def _merge(self, part: bytes) -> list[int]:
        """Ids of one part: the pair of lowest rank merges first, the leftmost of equal ones."""
        word = [self.byte_ids[b] for b in part]
        if len(word) > LONG:
            return self._merge_long(word)
        pairs, never = self.pairs, len(self.results)
        ranks = [pairs.get(a << 32 | b, never) for a, b in zip(word, word[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            k = ranks.index(best)
            word[k : k + 2] = [self.results[best]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = pairs.get(word[k] << 32 | word[k + 1], never)
            if k:
                ranks[k - 1] = pairs.get(word[k - 1] << 32 | word[k], never)
        return word

    def _merge_long(self, word: list[int]) -> list[int]:
        """The same by a heap over a linked list, for parts of many bytes."""
        pairs, size = self.pairs, len(word)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, k) for k in range(size - 1) if (r := pairs.get(word[k] << 32 | word[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k] if word[k] >= 0 else size
            if j >= size or pairs.get(word[k] << 32 | word[j]) != rank:
                continue
            word[k], word[j], after[k] = self.results[rank], -1, after[j]
            if after[k] < size:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < size and (r := pairs.get(word[x] << 32 | word[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return [w for w in word if w >= 0]

    def parts(self, piece: bytes) -> list[bytes]:
        """The piece cut at every certain pair."""
        cut = self.cut_pairs
        at = [k for k, (a, b) in enumerate(zip(piece, piece[1:]), 1) if cut[a << 8 | b]]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)])] if at else [piece]

    def _fragment(self, fragment: bytes) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self.pieces.findall(fragment.decode()):
            for part in self.parts(piece.encode()):
                ids += self._merge(part)
        return tuple(ids)

    def _plain(self, text: str, out: list[int]) -> None:
        cache, raw = self.cache, text.encode()
        for fragment in [raw] if RARE.search(raw) else self.cut.findall(raw):
            ids = cache.get(fragment)
            if ids is None:
                ids = self._fragment(fragment)
                if len(fragment) <= 64:
                    if self.cache_bytes >= self.cached:
                        cache.clear()
                        self.cache_bytes = 0
                    cache[fragment] = ids
                    self.cache_bytes += 200 + len(fragment) + 8 * len(ids)
            out += ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            self._plain(text[at : m.start()], out)
            out.append(self.added[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encoded(docs: DataFrame, vocabulary: str, text_col: str = "text", ids: bool = True, texts: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``token_ids`` and the ``decoded`` text.

    Rows are encoded and handed back ``BATCH_ROWS`` at a time, so a worker holds the ids and texts of few documents.
    """
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "token_ids": "array<int>", "decoded": "string"}
    keep = [c for c in docs.columns if c not in kinds]
    fields = [f for f in kinds if (ids or f != "token_ids") and (ids and texts or f != "decoded")]
    schema = T.StructType([*[docs.schema[c] for c in keep], *T.StructType.fromDDL(", ".join(f"{f} {kinds[f]}" for f in fields)).fields])
    given = "_text"
    while given in keep:
        given += "_"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                cells: dict[str, list] = {f: [] for f in fields}
                for text in part.column(names.index(given)):
                    found = bpe.encode(text.as_py() or "")
                    back = bpe.decode(found)
                    flat = np.asarray(found, "<u4")
                    row = (len(found), hashlib.sha256(flat.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                    for f, v in zip(fields, (*row, *([flat.astype(np.int32)] if ids else []), *([back] if ids and texts else []))):
                        cells[f].append(v)
                columns = [part.column(names.index(c)) for c in keep]
                arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
                columns += [pa.array(cells[f], arrow[kinds[f]]) for f in fields]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *fields])

    return docs.select(*keep, F.col(text_col).alias(given)).mapInArrow(apply, schema)


def decoded(frame: DataFrame, vocabulary: str, ids_col: str = "token_ids") -> DataFrame:
    """``frame`` with the text of its token ids; NULL ids give the empty text."""

    @F.pandas_udf(T.StringType())
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = codec(vocabulary)
        for lists in batches:
            yield pd.Series([bpe.decode([] if x is None else list(x)) for x in lists])

    return frame.withColumn("decoded", apply(F.col(ids_col)))
