"""Word hashes for operators that work on word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

from plume.llm.common import remembered

REMEMBERED_WORDS = 200_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def hashes(words: list[bytes]) -> np.ndarray:
    """The hash of each word; equal words have equal ones in every process."""
    known = remembered("words", WordHashes)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` neighbours in ``h``."""
    total = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(total)] + np.uint64(k + 1))
    return total
