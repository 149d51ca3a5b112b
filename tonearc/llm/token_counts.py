"""Token counts without ids: pieces are counted once per distinct pre-token of the corpus and joined to the pre-token
frequencies of documents.

Documents are handled a block at a time. A block's distinct pre-tokens go to hash buckets, once a block however often
they occur, so the most common word of the corpus is one row a block there; each bucket counts every distinct pre-token
once and answers with a few bytes a pre-token; the block, which kept its documents' frequencies as indices, sums up.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearc.llm import common as C
from tonearc.llm.encoding import Encoder

#: Pre-tokens whose counts a bucket's task keeps at once, twice over; one that comes again after so many others is counted anew.
REMEMBER = 1_000_000
#: Bytes of text in a block; larger blocks repeat fewer pre-tokens between them.
BLOCK_BYTES = 24 << 20


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _loose(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


_BLOCK = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("items", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("terms", pa.binary())])
_KIND = "block string, bucket int, items binary, doc_id array<long>, n_bytes array<long>, terms binary"


class _Block:
    """Distinct pre-tokens of the steps so far, and the frequencies of their documents."""

    def __init__(self):
        self.code: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.n_bytes: list[np.ndarray] = []
        self.per_doc: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.freqs: list[np.ndarray] = []
        self.size = 0

    def add(self, step: pa.RecordBatch) -> None:
        buf, rows = C.text_bytes(step.column("text"))
        starts, ends, first = C.space_chunks(buf, rows)
        code, found = C.distinct_pieces(buf, starts, ends)
        own = np.array([self.code.setdefault(p, len(self.code)) for p in found], np.int64)
        doc = np.repeat(np.arange(len(rows) - 1), np.diff(first))
        pair, n = np.unique(doc << 32 | (own[code] if len(own) else code), return_counts=True)
        self.per_doc.append(np.bincount(pair >> 32, minlength=len(rows) - 1))
        self.terms.append((pair & 0xFFFFFFFF).astype(np.uint32))
        self.freqs.append(n.astype(np.uint32))
        self.ids += step.column("doc_id").to_pylist()
        self.n_bytes.append(np.diff(rows))
        self.size += int(rows[-1])

    def rows(self, buckets: int) -> pa.RecordBatch:
        """A row per bucket with pre-tokens in order of bucket, and one (bucket null) with the documents."""
        pieces = list(self.code)
        bucket = np.array([zlib.crc32(p) % buckets for p in pieces], np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(pieces), np.uint32)
        place[order] = np.arange(len(pieces), dtype=np.uint32)
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        items, used = [], []
        for k in range(buckets):
            own = [pieces[i] for i in order[bounds[k] : bounds[k + 1]].tolist()]
            if own:
                sizes = np.array([len(p) for p in own], "<u4").tobytes()
                items.append(zstandard.ZstdCompressor(level=1).compress(len(own).to_bytes(4, "little") + sizes + b"".join(own)))
                used.append(k)
        terms = place[np.concatenate(self.terms)] if pieces else np.zeros(0, np.uint32)
        # Terms of a document in ascending order, as differences, with low bytes apart from high ones: half the size.
        per_doc = np.concatenate(self.per_doc)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        order = np.lexsort((terms, doc))
        terms, freqs = terms[order].astype(np.int64), np.concatenate(self.freqs)[order]
        step = np.diff(terms, prepend=0)
        head = C.prefix(per_doc)[:-1][per_doc > 0]
        step[head] = terms[head]
        blob = _squeeze(np.concatenate([[len(per_doc), len(terms)], per_doc]).astype("<u4"))
        low, high = _squeeze(step.astype("<u4").view(np.uint8).reshape(-1, 4).T), _squeeze(freqs.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        blob = len(blob).to_bytes(4, "little") + len(low).to_bytes(4, "little") + blob + low + high
        name, n = uuid.uuid4().hex, len(items)
        return C.batch(_BLOCK, [name] * (n + 1), pa.array([*used, None], pa.int32()), pa.array([*items, None], pa.binary()), pa.array([None] * n + [self.ids], pa.list_(pa.int64())), pa.array([None] * n + [np.concatenate(self.n_bytes)], pa.list_(pa.int64())), pa.array([None] * n + [blob], pa.binary()))


def _documents(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each document, their indices, their frequencies)."""
    a, b = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    head = _loose(blob[8 : 8 + a], "<u4").astype(np.int64)
    per_doc, n = head[2:], int(head[1])
    wide = lambda x: np.ascontiguousarray(_loose(x, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    step, freq = wide(blob[8 + a : 8 + a + b]), wide(blob[8 + a + b :])
    terms = np.cumsum(step)
    first = C.prefix(per_doc)[:-1][per_doc > 0]
    terms -= np.repeat(terms[first] - step[first], per_doc[per_doc > 0]) if len(first) else 0
    return per_doc, terms, freq


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row. A null text counts as empty (0 tokens);
    null ids and repeated rows stay as they are; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    parts = buckets or C.partitions(spark)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for step in C.text_steps(batches):
            block.add(step)
            if block.size >= BLOCK_BYTES:
                yield block.rows(parts)
                block = _Block()
        if block.ids:
            yield block.rows(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        young: dict[bytes, int] = {}
        old: dict[bytes, int] = {}
        for b in batches:
            out = []
            for blob in b.column("items").to_pylist():
                raw = zstandard.ZstdDecompressor().decompress(blob)
                n = int.from_bytes(raw[:4], "little")
                ends = C.prefix(np.frombuffer(raw, "<u4", n, 4)) + 4 + 4 * n
                counts = []
                for at, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    piece = raw[at:end]
                    k = young.get(piece)
                    if k is None:
                        k = old.get(piece)
                        young[piece] = k = len(encoder.encode(piece)) if k is None else k
                        if len(young) > REMEMBER:
                            young, old = {}, young
                    counts.append(k)
                out.append(_squeeze(np.array(counts, "<u4")))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "counts"])
        C.give_back()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, n_bytes, blob, answers in zip(b.column("doc_id"), b.column("n_bytes"), b.column("terms"), b.column("answers")):
                found = sorted((x["bucket"], x["counts"]) for x in (answers.as_py() or []))
                weight = np.concatenate([_loose(x, "<u4") for _, x in found] or [np.zeros(0)]).astype(np.int64)
                per_doc, terms, freq = _documents(blob.as_py())
                run = C.prefix(weight[terms] * freq)
                first = C.prefix(per_doc)
                n = run[first[1:]] - run[first[:-1]]
                yield pa.RecordBatch.from_arrays([ids.values, n_bytes.values, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    made = C.saved(C.id_and_text(docs, id_col, text_col).mapInArrow(blocks, _KIND), "pre-tokens")
    counted = made.where(F.col("bucket").isNotNull()).select("block", "bucket", "items").repartition(parts, "bucket").mapInArrow(count, "block string, bucket int, counts binary")
    answers = counted.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))
    whole = made.where(F.col("bucket").isNull()).select("block", "doc_id", "n_bytes", "terms").join(answers, "block", "left")
    return whole.mapInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
