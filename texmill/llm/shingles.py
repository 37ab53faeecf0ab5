"""Word shingles of whole texts as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit number, bounded; the number depends on the word alone."""

    def __init__(self, size: int = 150_000):
        super().__init__()
        self.most = size

    def __missing__(self, word: bytes) -> int:
        n = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = n
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, words: Words, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles of `width` words (A-Z lower-cased, split at ASCII white space).

    Fewer words make one shingle of the whole sequence; null, empty or blank text makes none.
    """
    parts = text.encode().lower().split() if text else ()  # bytes.lower() and split() touch ASCII alone
    if not parts:
        return np.empty(0, np.uint64)
    w, k = words.numbers(parts), min(width, len(parts))
    n = len(parts) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += mix(w[i : i + n] * _MULTIPLIERS[i])
    return np.unique(mix(h))
