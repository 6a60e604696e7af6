"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from broadloom.llm.common import SHINGLE_WORDS, Remembered

_MIX, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORDS = Remembered(lambda w: xxhash.xxh3_64_intdigest(w), 1 << 17)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word: runs of anything but ASCII white space, with A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def runs_hashed(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out *= _MIX
        out += words[j : len(words) - k + 1 + j]
    out ^= out >> np.uint64(31)
    out *= _END
    out ^= out >> np.uint64(29)
    return out


def shingle_set(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles in ascending order; fewer than ``k`` words are one shingle, no words none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return runs_hashed(words, len(words)) ^ np.uint64(len(words))
    return np.unique(runs_hashed(words, k))
