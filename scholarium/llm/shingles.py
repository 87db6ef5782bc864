"""Words and hashed word shingles of UTF-8 texts, for use inside tasks.

A word is a run of bytes other than space and \\x09-\\x0D, which is what
``bytes.split()`` returns.
"""

from __future__ import annotations

import numpy as np
import xxhash

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` words, in text order."""
    n = len(hashes) - width + 1
    h = np.full(max(0, n), width, np.uint64)
    for k in range(width if n > 0 else 0):
        h = (h ^ hashes[k : k + n]) * _A
        h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Distinct shingles of 63 bits, ascending.  Fewer words than ``width``: the whole sequence as one; no words: none."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(word_hashes(words), min(width, len(words))) >> np.uint64(1))
