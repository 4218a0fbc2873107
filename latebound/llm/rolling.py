"""Hashes of word windows inside Python tasks."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that multiplying by it loses nothing
_MIX = np.uint64(0xBF58476D1CE4E5B9)

#: Words remembered by a task; beyond it the memory starts anew.
MEMORY = 200_000


class WordHasher:
    """64-bit hashes of words, remembered while the memory lasts."""

    def __init__(self, seed: int = 7):
        self.seed, self.seen = seed, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if len(self.seen) > MEMORY:
            self.seen = {}
        seen, seed, out = self.seen, self.seed, []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = xxh64_intdigest(w, seed)
                if len(w) <= 64:
                    seen[w] = h
            out.append(h)
        return np.array(out, dtype=np.uint64)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive words (polynomial, then mixed); empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = out * _BASE + hashes[j:j + n]
        out = (out ^ (out >> np.uint64(30))) * _MIX
    return out ^ (out >> np.uint64(27))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values; empty if there are fewer."""
    if len(values) < size:
        return np.empty(0, dtype=values.dtype)
    out, width = values, 1
    while width < size:  # the least of 2, 4, ... values, then of the rest
        step = min(width, size - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))
