"""Best-fit packing of token sequences by linear grouping, planned on the histogram of lengths.

The plan never sees documents: the driver gets one count for each length up to the capacity, however large the corpus,
and returns runs, "the next n pieces of this length go to these sequences at this offset". Every piece then finds its
place by its rank among the pieces of its length, which is counted in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearc.llm import common as C
from tonearc.llm.encoding import Encoder

# ---- the plan --------------------------------------------------------------------------------------------------------


class _Bins:
    """Runs of equally filled bins: [bins, gap, [(length, first rank), ...]]."""

    def __init__(self, capacity: int):
        self.capacity, self.by_gap, self.room = capacity, [[] for _ in range(capacity + 1)], np.zeros(capacity + 1, bool)
        self.rank = np.zeros(capacity + 1, np.int64)

    def add(self, bins: int, slots: list[tuple[int, int]]) -> None:
        """bins of the same slots (length, first rank)."""
        gap = self.capacity - sum(s for s, _ in slots)
        self.by_gap[gap].append((bins, slots))
        self.room[gap] = True

    def take(self, length: int, n: int) -> int:
        """The first of n ranks of a length."""
        self.rank[length] += n
        return int(self.rank[length] - n)

    def best_fit(self, length: int, n: int) -> None:
        """n pieces of one length into the fullest bins that have room, then into new ones."""
        while n:
            found = int(np.argmax(self.room[length:])) + length
            if found < length or not self.room[found]:
                each = self.capacity // length
                bins, rest = divmod(n, each)
                if bins:
                    self.add(bins, [(length, self.take(length, bins)) for _ in range(each)])
                if rest:
                    self.add(1, [(length, self.take(length, 1)) for _ in range(rest)])
                return
            bins, slots = self.by_gap[found].pop()
            self.room[found] = bool(self.by_gap[found])
            use = min(bins, n)
            if bins > use:
                self.add(bins - use, [(s, r + use) for s, r in slots])
            self.add(use, [*slots, (length, self.take(length, use))])
            n -= use

    def runs(self) -> tuple[np.ndarray, int]:
        """Rows (length, first rank, number, first bin, offset), and the number of bins."""
        rows, at = [], 0
        for some in self.by_gap:
            for bins, slots in some:
                offset = 0
                for length, rank in slots:
                    rows.append((length, rank, bins, at, offset))
                    offset += length
                at += bins
        return np.array(sorted(rows), np.int64).reshape(-1, 5), at


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small, worth = sizes[order], values[order]
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        k = int(np.searchsorted(small, w, side="right"))
        if k:
            x = best[w - small[:k]] + worth[:k]
            i = int(np.argmax(x))
            if x[i] > best[w] + 1e-12:
                best[w], pick[w] = x[i], order[i]
    found, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if pick[w] >= 0:
            found[pick[w]] += 1
            w -= int(sizes[pick[w]])
        else:
            w -= 1
    return float(best[capacity]), found


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Configurations of few sizes and how often the linear relaxation uses each, by column generation until the duals
    prove the relaxation to be within a share `gap` of its optimum."""
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    pool, bound = np.zeros((0, m)), 0.0
    for turn in range(1, 40 * m + 1):
        used, duals = inverse @ need, inverse.sum(axis=0)
        worth = pool @ duals
        if len(pool) and worth.max() > 1 + gap:  # configurations found before come first: they cost no knapsack
            column = pool[int(np.argmax(worth))]
        else:
            best, column = _knapsack(sizes, np.maximum(duals, 0), capacity)
            bound = max(bound, used.sum() / best)
            if best <= 1 + gap or used.sum() <= bound * (1 + gap):
                break
            pool = np.concatenate([pool, column[None]])
        change = inverse @ column
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratio))
        columns[:, out] = column
        row = inverse[out] / change[out]
        inverse = np.linalg.inv(columns) if turn % 50 == 0 else inverse - np.outer(change, row)
        inverse[out] = inverse[out] if turn % 50 == 0 else row
    used = inverse @ need
    return [(columns[:, j].round().astype(int), float(used[j])) for j in range(m)]


def _grouped(counts: np.ndarray, capacity: int, groups: int, small: int) -> tuple[np.ndarray, int]:
    bins, left = _Bins(capacity), counts.copy()
    if left[capacity]:
        bins.best_fit(capacity, int(left[capacity]))
        left[capacity] = 0
    large = np.arange(capacity // small + 1, capacity)
    total = int(left[large].sum())
    if total:
        # Groups of equal cardinality, longest first; one size stands for all of a group. A length that spans groups makes them one.
        down = large[::-1]
        at = np.searchsorted(np.cumsum(left[down]), np.arange(0, total, -(-total // groups)) + 1)
        sizes = np.unique(down[at])
        need = np.bincount(np.searchsorted(sizes, large[large <= sizes[-1]]), weights=left[large[large <= sizes[-1]]], minlength=len(sizes))
        lows = np.append(capacity // small, sizes[:-1])
        lengths = np.arange(capacity + 1)

        def longest(low: int, high: int) -> int:
            """The longest length over low and up to high that is left, or 0."""
            some = np.flatnonzero(left[low + 1 : high + 1])
            return low + 1 + int(some[-1]) if len(some) else 0

        def substitute(own: list[int]) -> list[int]:
            """Actual lengths for the groups of a configuration: the longest of each, but the last two so that least is
            left of the sequence; the very last may be of any length, which takes up what rounding has set aside."""
            slots, gap = [], capacity
            for g in own[:-2]:
                found = longest(lows[g], sizes[g])
                if not found:
                    break
                slots.append(found)
                left[found] -= 1
                gap -= found
            g = own[-2]
            some = np.arange(min(sizes[g], gap), lows[g], -1)
            some = some[left[some] > 0]
            last = np.maximum.accumulate(np.where(left > 0, lengths, 0))[gap - some]
            bad = (last == 0) | ((last == some) & (left[some] < 2))
            waste = np.where(bad, capacity, gap - some - last)
            for s in slots:
                left[s] += 1
            k = int(np.argmin(waste)) if len(waste) and len(slots) == len(own) - 2 else -1
            return [*slots, int(some[k]), int(last[k])] if k >= 0 and waste[k] < capacity else []

        for column, times in sorted(configurations(sizes, need, capacity), key=lambda c: -int(np.flatnonzero(c[0])[-1])):
            own, times = np.repeat(np.arange(len(sizes)), column)[::-1].tolist(), int(np.ceil(times - 1e-9))
            while times > 0 and len(own) > 1 and (slots := substitute(own)):
                used, each = np.unique(slots, return_counts=True)
                run = min(times, int((left[used] // each).min()))
                bins.add(run, [(s, bins.take(s, run)) for s in slots])
                left[used] -= run * each
                times -= run
    for length in range(capacity, 0, -1):
        if left[length]:
            bins.best_fit(length, int(left[length]))
    return bins.runs()


def plan(counts: np.ndarray, capacity: int, groups: int = 16, small: tuple[int, ...] = (4, 8)) -> tuple[np.ndarray, int]:
    """Runs for counts[length] pieces of each length. Lengths over capacity / small are cut into groups of equal
    cardinality and rounded up to the longest of their group; configurations of these few sizes are optimised and filled
    with actual pieces; what is left over (also of configurations of one piece) and all small ones follow by best fit,
    longest first. This is done for each value of small, and the grouping of fewest sequences is returned."""
    return min((_grouped(counts.astype(np.int64), capacity, groups, s) for s in small), key=lambda r: r[1])


# ---- documents -------------------------------------------------------------------------------------------------------

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, with the task that made it and its rank among that task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = Encoder.of(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for step in C.text_steps(batches):
            buf, rows = C.text_bytes(step.column("text"))
            ids, first = encoder.encode_rows(buf, rows)
            ids = np.insert(ids.astype("<u4"), first[1:], end_id)
            first = first + np.arange(len(first))
            size = np.diff(first)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = C.ragged(np.zeros(len(n), np.int64), n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            at = first[doc] + start
            crc = [zlib.crc32(ids[a : a + k].data) for a, k in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            sizes, begin, many = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(begin, many) + np.repeat(seen[sizes], many)
            seen[sizes] += many
            yield C.batch(_PIECES, step.column("doc_id").take(pa.array(doc)), piece.astype(np.int32), start, length, crc, np.full(len(doc), task, np.int32), rank)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return C.id_and_text(docs, id_col, text_col).mapInArrow(cut, kind)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents, each followed by end_id, into sequences of at most capacity tokens: doc_id, piece, start,
    length, ids_crc32, sequence_id, offset. Only longer documents are cut. A null or empty text is one piece of one
    token; a null id stays null; repeated rows are packed each; an empty table gives no rows; other columns are ignored."""
    made = C.saved(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    tally = made.groupBy("task", "length").count()
    counts = np.zeros(capacity + 1, np.int64)
    for row in tally.groupBy("length").agg(F.sum("count").alias("n")).collect():  # a row per length: capacity at most
        counts[row.length] = row.n
    runs, _ = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    begin = runs[:, 0] << 44 | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("base").to_numpy()
            run = runs[np.searchsorted(begin, length << 44 | rank, side="right") - 1].reshape(-1, 5)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], [*names, "sequence_id", "offset"])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return made.join(base, ["task", "length"]).mapInArrow(place, kind)
