"""Sets of word shingles as 64-bit hashes, made text by text."""

from __future__ import annotations

import numpy as np
import xxhash

MOST_WORDS_KEPT = 200_000
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


class _WordHash(dict):
    """Hash of a word, kept while few are."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MOST_WORDS_KEPT:
            self[word] = value
        return value


_hash = _WordHash()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of what is not [\\x20\\x09-\\x0D], with A-Z lower-cased; bytes.lower and bytes.split know ASCII only."""
    return (text or b"").lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes(text: bytes | None) -> np.ndarray:
    return hashes_of(words_of(text))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row; of all the words where they are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = mix(out * _P[j % 5] + words[j : n - k + 1 + j])
    return out


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingle_hashes(word_hashes(text), k))


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed longs."""
    one = mix(values).sum(dtype=np.uint64)
    two = mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(values))
    return int(one.astype(np.int64)), int(two.astype(np.int64))
