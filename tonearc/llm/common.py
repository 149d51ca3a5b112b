"""Shared pieces: the shared folder, small-side size checks, and vectorised splitting of Arrow text columns."""

from __future__ import annotations

import ctypes
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step looks at.
STEP_BYTES = 2 << 20
#: Bytes up to which a checked side is broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, one of our own if everything runs in this
    process; executors of a cluster do not share a folder of this machine, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tonearc-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class _Scratch(threading.local):
    """Paths that this thread has written since each open scratch() began."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCRATCH = _Scratch()


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor takes nothing with it.
    keep: it outlives an open scratch()."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if _SCRATCH.open and not keep:
        _SCRATCH.open[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is saved inside is deleted at the end; the result must have been saved with keep by then."""
    _SCRATCH.open.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.open.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that saved() wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes that a row of a broadcast side has in memory besides its own, and times that its own count, at most: the index and
#: the pages of a hash table by one long double as they grow.
RELATION_BYTES, RELATION_GROWTH = 64, 2


def few_enough(rows: int, row_bytes: int) -> bool:
    """Whether the hash table of so many rows, of so many bytes each, may be broadcast."""
    return rows * (RELATION_BYTES + RELATION_GROWTH * row_bytes) <= BROADCAST_BYTES


def shuffled(side: DataFrame) -> DataFrame:
    """The side of a join, never broadcast. Spark's guess of a side is of compressed files and knows nothing of rows that
    an explode adds, so what it takes for 10 MB may be a gigabyte in the driver."""
    return side.hint("merge")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, under names of our own, so that no other column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_steps(batches: Iterator[pa.RecordBatch], step: int | None = None, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about step bytes of a column, one row at least. Memory goes back every few slices and
    at the end."""
    step, done = step or STEP_BYTES, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        off = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + step, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at, done = end, done + 1
            if done % 4 == 0:
                give_back()
    give_back()


def give_back() -> None:
    """Returns what this process has freed to the system: workers outlive their tasks, and the next stage's come on top."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a string column in its data buffer."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], kind, column.offset + len(column) + 1)
    return raw[column.offset :].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, 16 zeros after them, and where each row starts, one more than rows."""
    off = offsets(column)
    data = column.buffers()[2]
    out = np.zeros(int(off[-1] - off[0]) + 16, np.uint8)
    if data is not None and off[-1] > off[0]:
        out[:-16] = np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0]))
    return out, off - off[0]


_MASK = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)


def distinct_pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Code of each piece buf[start:end] and the distinct pieces by code. Exact: pieces of up to 16 bytes are compared
    as two words and a length after grouping by a hash of these, longer ones through a dictionary."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), []
    size = ends - starts
    words = np.ndarray((len(buf) - 8 + 1,), "<u8", buf.data, strides=(1,))
    lo = words[starts] & _MASK[np.minimum(size, 8)]
    hi = words[np.minimum(starts + 8, len(words) - 1)] & _MASK[np.clip(size - 8, 0, 8)]
    key = (lo ^ (lo >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (hi ^ (hi >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    code, _ = pd.factorize(key)
    code = code.astype(np.int64)
    first = np.zeros(int(code.max()) + 1, np.int64)
    first[code[::-1]] = np.arange(n - 1, -1, -1)
    rep = first[code]
    odd = np.flatnonzero((size > 16) | (lo[rep] != lo) | (hi[rep] != hi) | (size[rep] != size))
    raw = buf.tobytes()
    pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    if len(odd):
        more: dict[bytes, int] = {}
        for k, a, b in zip(odd.tolist(), starts[odd].tolist(), ends[odd].tolist()):
            piece = raw[a:b]
            c = more.get(piece)
            if c is None:
                c = more[piece] = len(pieces)
                pieces.append(piece)
            code[k] = c
    return code, pieces


def space_chunks(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts each row before every single space that no white space adjoins: (starts, ends, first chunk of each row,
    one more than rows). A byte-level pre-tokeniser of the usual kind never joins across such a place, so chunks may
    be tokenised on their own. Empty rows have no chunk."""
    n = int(rows[-1])
    b = buf[:n]
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    at = np.flatnonzero(b == 32)
    at = at[(at > 0) & (at < n - 1)]
    p1, p2, p3 = b[at - 1], b[np.maximum(at - 2, 0)], b[np.maximum(at - 3, 0)]
    n1, n2 = b[at + 1], buf[at + 2]
    odd = np.zeros(256, bool)
    odd[[0x80, 0x81, 0x9A]] = True
    # White space beyond ASCII starts with C2 85, C2 A0 or one of E1 9A, E2 80, E2 81, E3 80; not all that starts so is white space, but not cutting is always right.
    fine = (p1 > 32) & (n1 > 32) & ~((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) & ~((p3 >= 0xE1) & (p3 <= 0xE3) & odd[p2])
    fine &= ~((n1 == 0xC2) & ((n2 == 0x85) | (n2 == 0xA0))) & ~((n1 >= 0xE1) & (n1 <= 0xE3) & odd[n2])
    mark = np.zeros(n, bool)
    mark[at[fine]] = True
    mark[rows[:-1][rows[1:] > rows[:-1]]] = True
    starts = np.flatnonzero(mark)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, rows)


#: Bytes that are no word byte become spaces, A-Z become a-z; words are runs of 0-9, a-z and bytes from 0x80 on.
WORD_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def words(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row after lower-casing A-Z: (lowered bytes, starts, ends, first word of each row, one more than rows)."""
    n = int(rows[-1])
    low = WORD_BYTES[buf]
    low[n:] = 0
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = low[:n] != 32
    edge = np.diff(inside)
    # A word ends where its row ends.
    begin, end = edge == 1, edge == -1
    cut = rows[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    begin[cut] = end[cut] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    return low, starts, ends, np.searchsorted(starts, rows)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of first[i], first[i] + 1, ... (size[i] of them) for every i."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    keep = size > 0
    f, s = first[keep], size[keep]
    if total:
        out[0] = f[0]
        out[np.cumsum(s)[:-1]] = f[1:] - f[:-1] - s[:-1] + 1
    return np.cumsum(out)


def prefix(size: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values ascending, index of each element's value, counts), by sorting."""
    order = np.argsort(a, kind="stable")
    own = a[order]
    new = np.ones(len(a), bool)
    new[1:] = own[1:] != own[:-1]
    at = np.flatnonzero(new)
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return own[at], which, np.diff(np.append(at, len(a)))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of which row i is values[first[i]:first[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def quiet_tokenizers() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
