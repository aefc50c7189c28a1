"""Word shingles of texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from cloakwork.llm.anchors import _mix

_SEED = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hash of each word; at most ``limit`` words are kept, and none after a task: its worker may serve other stages."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        v = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = v
        return v


WORDS = Words()


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space (0x20, 0x09-0x0D), A-Z lower-cased."""
    words = text.lower().split()
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def ordered(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in their order."""
    acc = np.full(len(parts[0]), _SEED)
    for p in parts:
        acc = _mix((acc ^ p) * np.uint64(0xD6E8FEB86659FD93) + _SEED)
    return acc


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of all k words in a row; of fewer words, of the whole sequence; of none, nothing."""
    h = word_hashes(text or b"")
    if not len(h):
        return h
    if len(h) < k:
        return ordered([h[i : i + 1] for i in range(len(h))])
    return np.unique(ordered([h[i : len(h) - k + 1 + i] for i in range(k)]))
