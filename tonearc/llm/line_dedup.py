"""Repeated lines across documents: two Bloom filters find suspects, exact comparison of text decides.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Keys of at least min_chars code
points that at least two documents hold lose all their lines except in the smallest id that holds them.

1. Every task reduces its lines to distinct 64-bit hashes, each with whether one document or more of that batch hold it,
   so a line that a third of all documents share is one row a batch from here on. Hashes are cut into segments of at most
   SEGMENT_KEYS on average, however many lines there are.
2. Each segment's hashes stream through two Bloom filters, whose size was fixed before: what is seen first goes into the
   once-seen filter, what that already knows into the twice-seen one; nothing else is kept. Twice-seen filters are folded
   to what they hold and come back: by broadcast while they are small, else by a join on the segment.
3. Only lines that the twice-seen filter suspects are shuffled with their text. Equal keys are counted exactly (partial
   aggregation first) and the smallest id is chosen; what the filter suspected wrongly goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearc.llm import common as C

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes of a segment, so that its two filters take some 16 MB.
SEGMENT_KEYS = 4_000_000
#: Probes into a filter and bits a key: one key in a thousand is suspected wrongly.
PROBES, BITS_PER_KEY = 4, 16
#: A key that this many suspected lines or more hold is joined by broadcast; at most 1 / HOT_SHARE such keys exist.
HOT_SHARE = 1 / 2000


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


# ---- filters ---------------------------------------------------------------------------------------------------------


class Bloom:
    """A filter over 64-bit hashes; its size follows the number of keys."""

    def __init__(self, keys: int, bits: np.ndarray | None = None):
        size = 1 << max(10, int(np.ceil(np.log2(max(keys, 1) * BITS_PER_KEY))))
        self.bits = np.zeros(size >> 3, np.uint8) if bits is None else bits
        self.mask = np.uint64(len(self.bits) * 8 - 1)

    def places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = h.astype(np.uint64)
        a = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        b = (h * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        for _ in range(PROBES):
            at = (a >> np.uint64(17)) & self.mask
            yield (at >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8)
            a = a + b

    def add(self, h: np.ndarray) -> None:
        for at, bit in self.places(h):
            np.bitwise_or.at(self.bits, at, bit)

    def fold(self) -> None:
        """Halves the filter while it stays as sparse as it was planned to be; what it knows it still knows."""
        while len(self.bits) > 128:
            half = self.bits[: len(self.bits) // 2] | self.bits[len(self.bits) // 2 :]
            if np.bitwise_count(half).sum() > len(half) * 8 * PROBES / BITS_PER_KEY:
                return
            self.bits, self.mask = half, np.uint64(len(half) * 8 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at, bit in self.places(h):
            found &= (self.bits[at] & bit) != 0
        return found

    def where(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that the filter knows."""
        return np.flatnonzero(self.has(h))


def segment_of(h, segments: int):
    """Segment of hashes (an array or a column)."""
    if isinstance(h, Column):
        return (F.shiftrightunsigned(h, 40) % segments).cast("int")
    return ((h.astype(np.uint64) >> np.uint64(40)) % np.uint64(segments)).astype(np.int32)


def _distinct_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a batch, each once, and whether several documents of the batch hold it (documents are distinct in it)."""
    for b in batches:
        h, n = np.unique(b.column("hash").to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], ["hash", "twice"])


def _filters(keys: int):
    """The twice-seen filter of each segment in a partition, from batches (segment, hash, twice); keys: about as many
    hashes as a segment has."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[Bloom, Bloom]] = {}
        for b in batches:
            seg, h, twice = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(seg, kind="stable")
            kinds, at = np.unique(seg[order], return_index=True)
            for k, own in zip(kinds.tolist(), np.split(order, at[1:])):
                once, again = seen.setdefault(k, (Bloom(keys), Bloom(keys)))
                u, first, n = np.unique(h[own], return_index=True, return_counts=True)
                more = (n > 1) | once.has(u)
                more |= np.bincount(np.searchsorted(u, h[own][twice[own]]), minlength=len(u)) > 0
                again.add(u[more])
                once.add(u)
        for k, (_, again) in seen.items():
            if again.bits.any():
                again.fold()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([again.bits.tobytes()])], ["segment", "bits"])

    return build


def _suspected(batches: Iterator[pa.RecordBatch], filters: dict[int, Bloom], segments: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = b.column("hash").to_numpy()
        seg, ok = segment_of(h, segments), np.zeros(len(h), bool)
        order = np.argsort(seg, kind="stable")
        kinds, at = np.unique(seg[order], return_index=True)
        for k, own in zip(kinds.tolist(), np.split(order, at[1:])):
            if k in filters:
                ok[own] = filters[k].has(h[own])
        yield b.filter(pa.array(ok))


def suspects(keys: DataFrame, broadcast_bytes: int = C.BROADCAST_BYTES) -> DataFrame:
    """The rows of keys (doc_id, key, hash; a document's keys are distinct) whose hash the twice-seen filters know."""
    spark = keys.sparkSession
    hashes = C.saved(keys.select("hash").mapInArrow(_distinct_hashes, "hash long, twice boolean"), "line-hashes")
    total = hashes.count()
    segments = max(C.partitions(spark), -(-total // SEGMENT_KEYS))
    spread = hashes.select(segment_of(F.col("hash"), segments).alias("segment"), "hash", "twice").repartitionById(segments, "segment")
    found = C.saved(spread.mapInArrow(_filters(total // segments * 5 // 4 + 64), "segment int, bits binary"), "twice-seen")
    size = found.agg(F.sum(F.length("bits"))).first()[0] or 0
    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r.segment: bytes(r.bits) for r in found.collect()})

        def test(batches):
            yield from _suspected(batches, {k: Bloom(0, np.frombuffer(v, np.uint8)) for k, v in shared.value.items()}, segments)

        return keys.mapInArrow(test, keys.schema)

    def test_segment(key, rows: Iterator[pa.RecordBatch], bits: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {int(s): Bloom(0, np.frombuffer(v, np.uint8)) for b in bits for s, v in zip(b.column("segment").to_pylist(), b.column("bits").to_pylist())}
        yield from _suspected(rows, known, segments)

    # Beyond the bound a hash set by segment: only hashes travel, each once a task, and the suspected ones come back as a table.
    cogrouped = spread.select("segment", "hash").groupBy("segment").cogroup(found.groupBy("segment"))
    hashes = cogrouped.applyInArrow(lambda l, r: _cogrouped(l, r, segments), "segment int, hash long").select("hash").distinct()
    return keys.join(hashes, "hash", "left_semi").select(*keys.columns)


def _cogrouped(left: pa.Table, right: pa.Table, segments: int) -> pa.Table:
    known = {int(s): Bloom(0, np.frombuffer(v, np.uint8)) for s, v in zip(right.column("segment").to_pylist(), right.column("bits").to_pylist())}
    found = list(_suspected(iter(left.combine_chunks().to_batches()), known, segments))
    return pa.Table.from_batches(found, left.schema) if found else left.slice(0, 0)


# ---- lines -----------------------------------------------------------------------------------------------------------


def repeated_keys(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key) of every key that the document must lose. Rows that share an id are one document; a null id counts
    as the smallest."""
    text = C.id_and_text(docs, id_col, text_col)
    keys = F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    rows = text.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).withColumn("hash", F.xxhash64("key"))
    held = C.saved(suspects(rows), "suspected-lines")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id"))
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id"))
    counted = held.groupBy("key").agg(first.alias("first"), last.alias("last"), F.count(F.lit(1)).alias("n"))
    confirmed = C.saved(counted.where(~F.col("first").eqNullSafe(F.col("last"))).select("key", F.col("first.doc_id").alias("first_id"), "n"), "repeated-lines")
    least = max(1, int(held.count() * HOT_SHARE))
    hot, rest = confirmed.where(F.col("n") >= least), confirmed.where(F.col("n") < least)
    if (hot.agg(F.sum(F.length("key"))).first()[0] or 0) > C.BROADCAST_BYTES:  # few keys, but of very long lines
        joined = [held.join(confirmed, "key")]
    else:
        joined = [held.join(F.broadcast(hot), "key"), held.join(F.broadcast(hot).select("key"), "key", "left_anti").join(rest, "key")]
    return reduce(DataFrame.unionByName, joined).where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "key")


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row: doc_id, n_lines (before), n_dropped, kept (the other lines joined by \\n; a null or empty text is one
    empty line), and the columns named in carry. Rows that share an id are one document when lines are counted and keep
    a row each. Ties go to the smallest id; an empty table gives no rows; other columns are ignored."""
    lost = repeated_keys(docs, min_chars, id_col, text_col).groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_set("key").alias("lost"))
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("carried"))
    joined = text.join(lost.hint("shuffle_hash"), text.doc_id.eqNullSafe(lost.lost_id), "left")
    rows = joined.select("doc_id", "text", F.transform("lost", lambda k: k.cast("binary")).alias("lost"), "carried")
    lower = bytes.maketrans(_UPPER.encode(), _LOWER.encode())

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in C.text_steps(batches):
            column, n = step.column("text"), step.num_rows
            left: list[bytes | None] = [None] * n
            gone = np.zeros(n, np.int64)
            for k in np.flatnonzero(step.column("lost").is_valid().to_numpy(zero_copy_only=False)).tolist():
                lost_keys = set(step.column("lost")[k].as_py())
                lines = column[k].as_buffer().to_pybytes().split(b"\n")
                kept = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r").translate(lower) not in lost_keys]
                left[k], gone[k] = b"\n".join(kept), len(lines) - len(kept)
            lines = pc.add(pc.count_substring(column, "\n").cast(pa.int64()), 1)
            kept = pc.coalesce(pa.array(left, pa.binary()).view(pa.string()), column)
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), lines, pa.array(gone), kept, step.column("carried")], ["doc_id", "n_lines", "n_dropped", "kept", "carried"])

    kind = f"doc_id long, n_lines long, n_dropped long, kept string, carried {rows.schema['carried'].dataType.simpleString()}"
    out = rows.mapInArrow(drop, kind)
    return out.select("doc_id", "n_lines", "n_dropped", "kept", *[F.col("carried")[c].alias(c) for c in carry])


def digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, pos, line, (r.key IS NOT NULL AND k.doc_id <> r.first_id) AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
