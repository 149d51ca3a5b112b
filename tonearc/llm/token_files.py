"""Token-id files compressed by a Re-Pair grammar per shard, with random access to single documents.

A file holds the documents of one stretch of ascending ids. Pairs of neighbouring symbols are replaced by nonterminals,
the most frequent first, never across the end of a document, until no pair occurs twice. Pairs are counted and replaced
a round at a time: first those above falling shares of the shard, then all that occur twice; where occurrences overlap
the more frequent pair has them. The rules and the length of each rule's expansion are stored, so any document, or any
range of a document's ids, is decoded from its own symbols alone.

File: 8 bytes magic, 8 bytes length of a JSON header, the header, then the arrays that it lists: differences where they
ascend, then byte planes (no plane for bytes that are zero throughout), each zstd-compressed.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearc.llm import common as C
from tonearc.llm.encoding import Encoder

MAGIC = b"RPGRAM02"
#: Shares of a shard that a pair has to make up in the first rounds, as powers of two.
SHARES = (8, 11, 14, 17)


# ---- grammar ---------------------------------------------------------------------------------------------------------


def _places(left: np.ndarray, right: np.ndarray, at: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The places at of pairs (left, right), sorted by pair and then by place, and where runs of one pair start."""
    bits, low = max(int(symbols).bit_length(), 1), max(int(at[-1]).bit_length(), 1)
    if 2 * bits + low <= 64:  # pair and place in one number: sorted as plain numbers
        key = (left.astype(np.uint64) << np.uint64(bits) | right.astype(np.uint64)) << np.uint64(low) | at.astype(np.uint64)
        key.sort()
        at, pair = (key & np.uint64((1 << low) - 1)).astype(np.int64), key >> np.uint64(low)
    else:
        pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        order = np.argsort(pair, kind="stable")
        at, pair = at[order].astype(np.int64), pair[order]
    return at, np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))


def _every_second(at: np.ndarray, after: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Which of the places at (ascending; after: the places after them) hold a pair of equal symbols that overlaps the one
    before, which is counted."""
    out = np.zeros(len(at), bool)
    k = np.flatnonzero(equal)
    if len(k):
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1] + 1) | (after[k[:-1]] != at[k[1:]])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(k)), 0))
        out[k[(np.arange(len(k)) - start) % 2 == 1]] = True
    return out


class _Rules:
    """Rules of the rounds so far."""

    def __init__(self, terminals: int):
        self.left, self.right, self.sizes, self.symbols, self.first = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], np.ones(terminals, np.uint32), terminals, terminals

    def replace(self, seq: np.ndarray, at: np.ndarray, ranks: np.ndarray, before: np.ndarray | None, after: np.ndarray | None, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One round over the pairs at places at (ascending): (places that are replaced, their new symbols, other places of
        the pairs that were frequent enough). before, after: the places next to each, if not its neighbours; ranks: scratch
        by place (-1 and one more than there are included, from 1), full of the largest number."""
        none = np.zeros(0, np.int64)
        behind = (lambda x: x + 1) if after is None else after.__getitem__
        if not len(at):
            return none, none, none
        place, run = _places(seq[at], seq[behind(at)], at, self.symbols)
        n = np.diff(np.append(run, len(place)))
        good = np.flatnonzero(n >= level)
        if not len(good):
            return none, none, none
        # The better rank wins of two that overlap, the left one of equals; ranks follow the counts.
        rank = np.empty(len(good), np.int32)
        rank[np.argsort(-n[good], kind="stable")] = np.arange(len(good), dtype=np.int32)
        some = C.ragged(run[good], n[good])
        place, own = place[some], np.repeat(rank, n[good])
        ranks[place + 1] = own
        wins = (own < ranks[place if before is None else before[place] + 1]) & (own <= ranks[behind(place) + 1])
        ranks[place + 1] = np.iinfo(np.int32).max
        used = np.bincount(own[wins], minlength=len(good))
        wins &= used[own] >= 2  # what wins only once is no repetition now
        some = np.flatnonzero(used >= 2)
        if not len(some):
            return none, none, place
        first, second = np.empty(len(good), np.int32), np.empty(len(good), np.int32)
        heads = place[C.prefix(n[good])[:-1]]
        first[rank], second[rank] = seq[heads], seq[behind(heads)]
        # Numbers of a round: by how many bits the uses have, then by the pair, so that differences are small.
        order = some[np.lexsort((second[some], first[some], -np.frexp(used[some])[1]))]
        number = np.zeros(len(good), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        self.left.append(first[order])
        self.right.append(second[order])
        self.sizes = np.concatenate([self.sizes, self.sizes[first[order]] + self.sizes[second[order]]])
        out = place[wins], self.symbols + number[own[wins]], place[~wins]
        self.symbols += len(order)
        return out


def compress(ids: np.ndarray, first: np.ndarray, terminals: int, shares: tuple[int, ...] = SHARES) -> dict[str, np.ndarray]:
    """Grammar of ids, of which row i is ids[first[i]:first[i + 1]]: left and right of the rules, their expansion sizes,
    the symbols that are left, where each row starts among them. No pair of neighbours in a row is left at two places
    that do not overlap."""
    seq = ids.astype(np.int32)
    last = np.zeros(len(seq), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    rules, never = _Rules(terminals), np.iinfo(np.int32).max
    ranks = np.full(len(seq) + 2, never, np.int32)
    # Rounds over all places, after each of which the sequence is closed up.
    for level in [max(2, len(seq) >> s) for s in shares] + [2]:
        at = np.flatnonzero(~last[:-1]) if len(seq) > 1 else np.zeros(0, np.int64)
        if level > 2:  # counts by hash come first: only places whose bucket is full enough are sorted
            bucket = (seq[:-1].view(np.uint32) * np.uint32(0x9E3779B1) + seq[1:].view(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(12)
            at = at[(np.bincount(bucket, minlength=1 << 20) >= level)[bucket[at]]]
        at = at[~_every_second(at, at + 1, seq[at] == seq[at + 1])] if len(at) else at
        won, symbol, lost = rules.replace(seq, at, ranks, None, None, level)
        seq[won] = symbol
        last[won] = last[won + 1]
        keep = np.ones(len(seq), bool)
        keep[won + 1] = False
        if level == 2:
            number = np.cumsum(keep) - 1
            hot = np.concatenate([number[won], number[won] - 1, number[lost[keep[lost]]]])
        seq, last = seq[keep], last[keep]
    # Rounds over the places whose pair may have come to occur again: those next to new symbols and those that lost. The
    # sequence stays as it is, with the places before and after each symbol.
    n = len(seq)
    if n > 1:
        before, after, alive, mark = np.arange(-1, n - 1), np.arange(1, n + 1), np.ones(n, bool), np.zeros(n, bool)
        mark[hot[hot >= 0]] = True
        while len(hot := np.flatnonzero(mark & alive & ~last)):
            mark[:] = False
            odd = _every_second(hot, after[hot], seq[hot] == seq[after[hot]])
            won, symbol, lost = rules.replace(seq, hot[~odd], ranks, before, after, 2)
            if not len(won):
                break
            dead = after[won]
            seq[won], last[won], alive[dead] = symbol, last[dead], False
            after[won] = after[dead]
            inner = after[won] < n
            before[after[won][inner]] = won[inner]
            left = before[won]
            for some in (won, left[left >= 0], lost, hot[odd]):
                mark[some] = True
        seq, last = seq[alive], last[alive]
    stop = np.flatnonzero(last) + 1
    rows = np.zeros(len(first), np.int64)
    rows[1:] = np.append(0, stop)[np.cumsum(first[1:] > first[:-1])]
    return {"left": np.concatenate(rules.left).astype(np.uint32), "right": np.concatenate(rules.right).astype(np.uint32), "size": rules.sizes[terminals:], "symbols": seq.astype(np.uint32), "rows": rows}


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray, terminals: int) -> np.ndarray:
    """All symbols replaced by what they stand for, each rule in its place, level by level."""
    own = symbols.astype(np.int64)
    rule = own >= terminals
    length = np.ones(len(own), np.int64)
    length[rule] = size[own[rule] - terminals]
    at = C.prefix(length)
    out = np.empty(int(at[-1]), np.uint32)
    at = at[:-1]
    while len(own):
        out[at[~rule]] = own[~rule]
        own, at = own[rule] - terminals, at[rule]
        a, b = left[own].astype(np.int64), right[own].astype(np.int64)
        wide = np.ones(len(a), np.int64)
        deep = a >= terminals
        wide[deep] = size[a[deep] - terminals]
        own, at = np.concatenate([a, b]), np.concatenate([at, at + wide])
        rule = own >= terminals
    return out


# ---- files -----------------------------------------------------------------------------------------------------------


def _planes(a: np.ndarray, differences: bool) -> list[bytes]:
    """Byte planes of whole numbers, low ones first, compressed; differences are taken modulo 2^64."""
    a = a.astype(np.int64).view(np.uint64)
    if differences:
        step = np.diff(a, prepend=np.uint64(0)).view(np.int64)
        a = (step << 1 ^ step >> 63).view(np.uint64)  # small ones stay small, whatever their sign
    raw = a.astype("<u8").view(np.uint8).reshape(-1, 8)
    most = int(np.bitwise_or.reduce(a)) if len(a) else 0
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range((most.bit_length() + 7) // 8)]


def _unplaned(planes: list[bytes], n: int, differences: bool) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    for k, p in enumerate(planes):
        raw[:, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8)
    a = raw.view("<u8").ravel()
    if differences:
        a = np.cumsum((a >> np.uint64(1)) ^ (np.uint64(0) - (a & np.uint64(1))))
    return a.view(np.int64)


#: Arrays of a file that are stored as differences.
_ASCENDING = ("left", "rows", "doc_id", "start")


def pack(doc_ids: list[int | None], ids: np.ndarray, first: np.ndarray, terminals: int) -> bytes:
    arrays = compress(ids, first, terminals) | {"doc_id": np.array([0 if x is None else x for x in doc_ids], np.int64), "no_id": np.array([x is None for x in doc_ids], np.int64), "start": first.astype(np.int64)}
    blobs = {k: _planes(v, k in _ASCENDING) for k, v in arrays.items()}
    head = json.dumps({"terminals": terminals, "arrays": [[k, len(arrays[k]), [len(x) for x in b]] for k, b in blobs.items()]}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(x for b in blobs.values() for x in b)


class TokenFile:
    """A file read into memory."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(data[8:16], "little")
        head, at = json.loads(data[16 : 16 + n]), 16 + n
        self.terminals, self.arrays = head["terminals"], {}
        for name, n, sizes in head["arrays"]:
            ends = [at + int(x) for x in np.cumsum(sizes)] if sizes else []
            self.arrays[name] = _unplaned([data[a:z] for a, z in zip([at, *ends], ends)], n, name in _ASCENDING)
            at += sum(sizes)
        self.doc_ids = [None if x else y for x, y in zip(self.arrays["no_id"].tolist(), self.arrays["doc_id"].tolist())]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def all_ids(self) -> np.ndarray:
        a = self.arrays
        return expand(a["symbols"], a["left"], a["right"], a["size"], self.terminals)

    def ids(self, row: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of one document; only the symbols that cover them are expanded."""
        a = self.arrays
        own = a["symbols"][a["rows"][row] : a["rows"][row + 1]].astype(np.int64)
        rule = own >= self.terminals
        size = np.ones(len(own), np.int64)
        size[rule] = a["size"][own[rule] - self.terminals]
        ends = np.cumsum(size)
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        lo, hi = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[lo - 1]) if lo else 0
        return expand(own[lo:hi], a["left"], a["right"], a["size"], self.terminals)[start - before : max(stop, start) - before]


def write_file(folder: str, name: str, data: bytes) -> str:
    """Written under a name that no other attempt uses; only the attempt whose row is kept is ever read."""
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base, recursive=True)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(path) as f:
        f.write(data)
    return f"{folder}/{path.rsplit('/', 1)[1]}"


def read_file(path: str) -> bytes:
    where, base = fs.FileSystem.from_uri(path)
    with where.open_input_stream(base) as f:
        return f.read()


_MANIFEST = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, file_ids: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending id order (nulls first; rows that share an id stay separate, in any order) and
    returns the manifest: shard, part, path, n_docs, n_ids, n_bytes. A null text counts as empty: its only id is end_id.

    Documents are range-partitioned by id, so every task writes the files of one stretch of ids; a file is closed
    once it holds file_ids ids. An empty table gives no file."""
    spark = docs.sparkSession
    folder = folder or C.new_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, part = Encoder.of(tokenizer, remember=700_000), TaskContext.get().partitionId(), 0
        terminals = max(encoder.tokenizer.get_vocab_size(True), end_id + 1)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal part, total
            data = pack(names, np.concatenate(held), C.prefix(np.concatenate(sizes)), terminals)
            row = C.batch(_MANIFEST, [shard], [part], [write_file(folder, f"shard-{shard:06d}-{part:04d}", data)], [len(names)], [total], [len(data)])
            part, total = part + 1, 0
            names.clear(), held.clear(), sizes.clear()
            return row

        for step in C.text_steps(batches):
            buf, rows = C.text_bytes(step.column("text"))
            ids, first = encoder.encode_rows(buf, rows)
            held.append(np.insert(ids.astype(np.uint32), first[1:], end_id))
            sizes.append(np.diff(first) + 1)
            names += step.column("doc_id").to_pylist()
            total += len(held[-1])
            if total >= file_ids:
                yield flush()
        if names:
            yield flush()

    ordered = C.id_and_text(docs, id_col, text_col).repartitionByRange(C.partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    kind = "shard long, part long, path string, n_docs long, n_ids long, n_bytes long"
    return C.saved(ordered.mapInArrow(write, kind), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as
    little-endian uint32). The running sum goes over one small row a file."""
    order = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for path, begin in zip(some.column("path").to_pylist(), some.column("before").to_pylist()):
                file = TokenFile(read_file(path))
                ids = file.all_ids().astype("<u4")
                first = file.arrays["start"]
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield C.batch(_READ, file.doc_ids, first[:-1] + begin, np.diff(first), crc)

    return before.repartition(C.partitions(manifest.sparkSession), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
