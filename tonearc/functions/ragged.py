"""Lists of many documents as flat arrays: what Python workers do with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Tokens that a worker handles at once.
PIECE = 500_000


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose lists hold about so many elements together; a longer list stays whole."""
    ends = np.asarray(batch.column(column).offsets)[1:].astype(np.int64)
    if not len(ends):
        return
    base, first = int(np.asarray(batch.column(column).offsets)[0]), 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(first, last - first)
        base, first = int(ends[last - 1]), last


def flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    """Bounds of the lists, and their elements; a null list is empty."""
    lists = batch.column(column)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), lists.flatten()


def coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number for each word, -1 for null, and the distinct words."""
    d = words.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def in_turn(starts: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of ascending starts a reader from left to right takes: one inside a taken one is no start."""
    out, end = np.zeros(len(starts), bool), -1
    for k, (a, n) in enumerate(zip(starts.tolist(), spans.tolist())):
        if a >= end:
            out[k], end = True, a + n
    return out


def one_hash(words: list[str], seed: int) -> np.ndarray:
    """64 bits of each word."""
    from pandas.util import hash_array

    return hash_array(np.array(words, object), hash_key=f"{seed:016d}", categorize=False) if words else np.zeros(0, np.uint64)


def joined_hash(parts: list[np.ndarray]) -> np.ndarray:
    """64 bits of phrases from those of their words in order."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h
