"""Content-chosen anchors of byte strings: every window of WIDTH bytes has exactly one, found from its own bytes."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k bytes of data, by doubling: hash(2n) = hash(n) * P**n + hash(n) n further."""
    h, n, p = data.astype(np.uint64) + np.uint64(1), 1, _P
    parts, at = None, 0
    while True:
        if k & n:
            if parts is None:
                parts = h
            else:
                m = min(len(parts), len(h) - at)
                parts = parts[:m] * np.uint64(p) + h[at : at + m]
            at += n
        if n * 2 > k:
            break
        h = h[: len(h) - n] * np.uint64(p) + h[n:]
        n, p = n * 2, p * p & (1 << 64) - 1
    return _mix(parts[: len(data) - k + 1])


def sliding(h: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every w values in a row."""
    n = 1
    while n * 2 <= w:
        h = pick(h[: len(h) - n], h[n:])
        n *= 2
    return pick(h[: len(h) - (w - n)], h[w - n :]) if w > n else h


def anchors(data: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): each anchor and the windows it stands for, by their starts first..last.

    A window's anchor is the leftmost of its k-grams with the least hash, so equal windows have equal anchors
    at equal places in them. Every start 0..len-width belongs to exactly one anchor. Shorter data have none.
    """
    if len(data) < width:
        e = np.zeros(0, dtype=np.int64)
        return e.astype(np.uint64), e, e, e
    h, w = gram_hashes(data, k), width - k + 1
    least = sliding(h, w, np.minimum)
    # windows in a row with the same least hash
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(least)]]) - 1
    value = least[first]
    pad = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    spots = np.flatnonzero(sliding(pad, w, np.maximum)[: len(h)] == h)
    found = [[], [], [], []]
    todo = np.arange(len(first))
    begin = first.copy()
    while len(todo):
        j = np.searchsorted(spots, begin[todo])
        while True:
            wrong = h[spots[j]] != value[todo]
            if not wrong.any():
                break
            j[wrong] += 1
        place = spots[j]
        end = np.minimum(place, last[todo])
        for out, v in zip(found, (value[todo], place, begin[todo], end), strict=True):
            out.append(v)
        more = end < last[todo]
        begin[todo] = end + 1
        todo = todo[more]
    value, place, begin, end = (np.concatenate(x) for x in found)
    order = np.argsort(begin, kind="stable")
    return value[order], place[order], begin[order], end[order]
