"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from ._session import MEMOS

WORDS = 5
#: Odd multipliers for the places in a shingle, from a fixed rule.
PLACES = np.array([xxhash.xxh3_64_intdigest(bytes([i])) | 1 for i in range(WORDS)], np.uint64)
KNOWN = 200_000


class WordHashes(dict):
    """The worker's memo of word hashes, bounded by KNOWN between texts."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
MEMOS.append(_HASHES)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles; of fewer words, the whole sequence as one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_HASHES) > KNOWN:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    if n < 1:
        return mix(np.array([(h * PLACES[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))
    s = h[:n] * PLACES[0]
    for i in range(1, WORDS):
        s += h[i : n + i] * PLACES[i]
    return np.unique(mix(s))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    return len(np.intersect1d(a, b, assume_unique=True))
