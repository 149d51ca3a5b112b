"""Rolling word windows of documents joined to those of a small reference side (benchmarks, licence templates)."""

from __future__ import annotations

import numpy as np

#: Reference windows up to this number go to every task as a filter of their hashes (8 bytes each, 16 MB at most); more of
#: them as a Bloom filter.
FILTER_WINDOWS = 2_000_000


class Known:
    """Tests hashes against a sorted set; a bit table by low bits settles most of them."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.astype(np.uint64))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.sorted & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def where(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that the set has."""
        at = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at) or not len(self.sorted):
            return at[:0]
        k = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        return at[self.sorted[k] == h[at]]


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of all runs of n values inside rows."""
    runs = np.maximum(np.diff(first) - n + 1, 0)
    m = len(h) - n + 1
    if m <= 0 or not runs.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = np.full(m, n, np.uint64)
    for k in range(n):
        own = (own ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        own ^= own >> np.uint64(32)
    inside = np.zeros(m + 1, np.int32)  # a run's start is inside its row
    begin = first[:-1][runs > 0]
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + runs[runs > 0], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return at, own[at]
