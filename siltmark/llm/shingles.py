"""Shingle sets of texts and their MinHash signatures, computed in Arrow batches inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case (bytes.lower touches nothing else)."""
    return text.encode().lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _FOLD
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], memo: WordHashes, width: int) -> np.ndarray:
    """Hashes of the shingles in order of place; fewer words than ``width`` are one shingle, none give none."""
    if not words:
        return np.zeros(0, np.uint64)
    return shingles_in_a_row(np.array(list(map(memo.__getitem__, words)), np.uint64), width)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of ``WordHashes`` without remembering; faster where most words are short."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles_in_a_row(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of words with hashes ``h``."""
    span = min(width, h.size)
    out = np.full(h.size - span + 1, span, np.uint64)
    for k in range(span):
        out = mixed(out * _MIX + h[k : h.size - span + 1 + k])
    return out


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


class MinHasher:
    """``size`` minima of multiply-add images of the set, as unsigned 32-bit numbers."""

    def __init__(self, size: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, size, dtype=np.uint64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        low = np.full(self.a.size, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, values.size, 1024):  # a block of images stays in the processor's cache
            part = values[at : at + 1024]
            np.minimum(low, (part[:, None] * self.a + self.b).min(0), out=low)
        return (low >> np.uint64(32)).astype(np.uint32)
