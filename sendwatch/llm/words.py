"""Words and word shingles of texts as 64-bit hashes, for Arrow batches.

A word is ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased (nothing
else is changed), which is what ``bytes.lower().split()`` gives on UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

from sendwatch.llm.worker import state

SHINGLE = 5
MEMO = 100_000  # words of at most 40 bytes, some 15 MB
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                     0xFF51AFD7ED558CCD], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = value
        return value


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of every word, in order."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(state("words", "hashes", _Hashes).__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Hash of every 5-word window in order; of fewer words, the whole sequence as one."""
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += h[i:i + n] * _WEIGHTS[i]
    return mix(total)
