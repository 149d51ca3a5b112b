"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases of two letters or more, the phrases into longer phrases, and so on. Where a phrase ends
depends on few neighbours only: deterministic coin tossing turns symbols into labels of a handful of values, and ends
lie where labels peak. A phrase's name is a hash of the names in it. So equal substrings get equal phrases except near
their ends, wherever they stand.

A fingerprint is two bottom-k sketches, of the names of levels below FIRST (short phrases, of which unrelated texts share
some) and of those from FIRST on (which few texts share, but of which short texts have few). Every text has both. The
likeness of two fingerprints is the mean of the two Jaccard estimates, weighted by m : SHORT_WEIGHT for the long phrases,
where m is the smaller number of long names: it passes from the one to the other without a step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonearc.llm import common as C
from tonearc.llm.ordering import with_next

#: Levels of the hierarchy; names of levels below FIRST are short phrases.
LEVELS, FIRST = 6, 3
#: Names in the sketches of short and of long phrases; the likeness of two sketches errs by about 1 / sqrt(names).
SHORT, SKETCH = 64, 128
#: What short phrases weigh against the number of long ones.
SHORT_WEIGHT = 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def _toss(symbols: np.ndarray, same: np.ndarray) -> np.ndarray:
    """A label: where the symbol first differs from the one before it, and its bit there. Neighbours that differ keep
    different labels. The first symbol of a run (`same` marks where the one before is of another row) gets its own bit."""
    before = np.empty_like(symbols)
    before[0] = symbols[0]
    before[1:] = symbols[:-1]
    low = symbols ^ before
    low[same] = 1
    low &= -low if low.dtype.kind == "i" else (~low + low.dtype.type(1))
    at = np.bitwise_count(low - low.dtype.type(1)).astype(np.uint8)
    return (at << np.uint8(1)) | ((symbols >> at.astype(symbols.dtype)) & symbols.dtype.type(1)).astype(np.uint8)


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of all rows, and the first of each row, one more than rows.

    Runs of one name become a symbol of their own first, so neighbours always differ."""
    if not len(names):
        return names, first
    head = np.zeros(len(names), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new |= head
    at = np.flatnonzero(new)
    if len(at) < len(names):
        run = np.diff(np.append(at, len(names))).astype(np.uint64)
        names = np.where(run > 1, _mix(names[at] + run * _B), names[at])
        head = head[at]
        first = np.searchsorted(at, first)
    label = _toss(names, head)  # < 128
    label = _toss(label, head)  # < 16
    label = _toss(label, head)  # < 8
    low = label.view(np.int8)
    peak = np.zeros(len(names), bool)  # a phrase starts where the label is larger than both neighbours'
    peak[1:-1] = (low[1:-1] > low[:-2]) & (low[1:-1] >= low[2:])
    peak[:-1] &= ~head[1:]  # the last symbol of a row has no neighbour after it
    peak |= head
    start = np.flatnonzero(peak)
    size = np.diff(np.append(start, len(names)))
    inside = np.arange(len(names)) - np.repeat(start, size)
    term = _mix(names + (inside.astype(np.uint64) + np.uint64(1)) * _B)
    return _mix(np.add.reduceat(term, start) + size.astype(np.uint64)), np.searchsorted(start, first)


def sketches(points: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row, the smallest SHORT names of its short phrases and the smallest SKETCH names of its long ones (all of
    a row's names where they are fewer); points: code points."""
    names, rows = _mix(points.astype(np.uint64) + np.uint64(1)), first
    found: tuple[list, list] = [], []
    for level in range(1, LEVELS + 1):
        names, rows = parse(names, rows)
        owner = np.repeat(np.arange(len(rows) - 1, dtype=np.uint64), np.diff(rows))
        found[level >= FIRST].append(owner << np.uint64(32) | names >> np.uint64(32))
    parts = []
    for some, size in zip(found, (SHORT, SKETCH)):
        key = np.concatenate(some)
        key.sort()
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        bounds = np.searchsorted(key >> np.uint64(32), np.arange(len(first), dtype=np.uint64))
        short = (key & np.uint64(0xFFFFFFFF)).astype(">u4")
        parts.append([short[a : min(z, a + size)] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
    return list(zip(*parts))


def _jaccard(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Estimate of the Jaccard similarity of the name sets of two sketches; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    k = min(size, len(both)) if len(a) >= size or len(b) >= size else len(both)
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both[:k], assume_unique=True)) / k


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Likeness of two fingerprints, 0 to 1; 1 for two empty ones."""
    long = min(len(a[1]), len(b[1]))
    short = _jaccard(a[0], b[0], SHORT)
    return (SHORT_WEIGHT * short + long * _jaccard(a[1], b[1], SKETCH)) / (SHORT_WEIGHT + long) if long else short


def show(sketch: tuple[np.ndarray, np.ndarray]) -> str:
    """Names of short phrases, a colon, names of long ones; empty for a text without letters."""
    return ":".join(s.tobytes().hex() for s in sketch) if len(sketch[0]) else ""


def compare(fingerprint: str, other: str) -> float:
    """likeness() of two fingerprints as shown."""
    read = lambda f: tuple(np.frombuffer(bytes.fromhex(x), ">u4") for x in (f or ":").split(":"))
    return likeness(read(fingerprint), read(other))


def _points(text: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = "".join(text).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), C.prefix(np.array([len(t) for t in text], np.int64))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: doc_id, n_chars, fingerprint, and, of the text whose last quarter (rounded down) is replaced by the
    beginning of the next document's text, edited_sha256 and edited_fingerprint; near_edited and near_next: likeness of
    the fingerprint to the edited text's and to the next document's. Next: in ascending id order, after the last the
    first; null ids come first, rows that share an id go by text. A null text counts as empty (its fingerprint is
    empty); an empty table gives no rows; other columns are ignored."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        text, after = b.column("text").to_pylist(), b.column("next").to_pylist()
        edited = []
        for t, n in zip(text, after):
            q = len(t) // 4
            edited.append(t[: len(t) - q] + n[:q])
        # A row's next is the row after it, but for the last one.
        own = sketches(*_points([*text, after[-1]]))
        changed = sketches(*_points(edited))
        return pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), pa.array([len(t) for t in text], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array([show(s) for s in own[:-1]]), pa.array([show(s) for s in changed]),
                pa.array([likeness(x, y) for x, y in zip(own, changed)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(own, own[1:])], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(C.id_and_text(docs, id_col, text_col), work, _SCHEMA)
