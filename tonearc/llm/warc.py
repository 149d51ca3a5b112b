"""WARC archives with a two-level capture index.

Writing: pages are joined to the first page of equal payload, and each task appends gzip members to archives of its own. A
payload that an earlier page id has becomes a revisit record.

Index: capture lines, sorted by (URL key, page id), are written in compressed blocks of BLOCK_LINES, a file for each
stretch of keys; beside it a sparse directory keeps the first and last key of each block. A lookup finds the stretch among
their bounds (a short row each), binary-searches that stretch's directory, reads the one range of the index file that can
hold the key, binary-searches its lines, and reads the ranges of the archives that they name. Whole tables of lookups run
in parallel, sorted, so that a block or a neighbouring range is read once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearc.llm import common as C

BLOCK_LINES = 1000
#: An archive is closed once it holds so many bytes.
ARCHIVE_BYTES = 1 << 30
#: Bytes of an archive that one task reads in sequence, and bytes of one read.
CHUNK_BYTES = 1 << 20
#: Characters of keys that the bounds of a stretch keep; longer keys only widen the search.
BOUND_CHARS = 200
_DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query; without scheme, user, port, fragment and letter case
    of the host. Every string has one: nothing is looked up or rejected, so a malformed host is only letters to sort."""
    if not url:
        return ""
    scheme, mark, rest = url.partition("://")
    if not mark or any(c in scheme for c in "/?#"):
        rest = url.removeprefix("//")
    rest = rest.split("#", 1)[0]
    cut = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host, tail = rest[:cut].rsplit("@", 1)[-1], rest[cut:]
    name, colon, port = host.rpartition(":")
    if colon and (not port or port.isdecimal()):
        host = name
    return ",".join(reversed(host.lower().split("."))) + ")" + (tail if tail.startswith("/") else "/" + tail)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, own: str | None = None) -> bytes:
    """One record; first: the page that holds the payload, for a revisit; own: the payload's digest, where it is known."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"Content-Length: {len(payload)}\r\n\r\n".encode())
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(first)}"]
    head += [f"WARC-Payload-Digest: sha1:{own or digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_digest (as written), payload_bytes, payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    number = lambda uri: int(uri[len("<urn:x-page:") : -1]) if uri and uri != _uri(None) else None
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": size, "payload": payload if kind == "response" else None,
    }


# ---- writing ---------------------------------------------------------------------------------------------------------

_CAPTURE = "url_key string, page_id long, digest string, record_type string, path string, offset long, length long"
_CAPTURE_NAMES = ["url_key", "page_id", "digest", "record_type", "path", "offset", "length"]


def firsts(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of all pages (page_id, sha, size) that revisit another: equal payload of at least
    `least` bytes, smaller id."""
    meta = pages.select("page_id", "sha", "size").where((F.col("size") >= least) & F.col("page_id").isNotNull())
    # Aggregated before it is joined, and only digests that several pages share are joined: by broadcast those that hold
    # a thousandth of all pages or more (a thousand at most), the others by a shuffle.
    shared = C.saved(meta.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "shared-payloads")
    hot = max(2, (shared.agg(F.sum("n")).first()[0] or 0) // 1000)
    big, rest = shared.where(F.col("n") >= hot), shared.where(F.col("n") < hot)
    one = meta.join(F.broadcast(big), "sha")
    two = meta.join(F.broadcast(big).select("sha"), "sha", "left_anti").join(rest, "sha")
    return one.unionByName(two).where(F.col("first") != F.col("page_id")).select("page_id", "sha", F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, level: int = 4, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a record per row and returns the captures: url_key, page_id, digest, record_type, path, offset, length.

    A null payload counts as empty; a null URL has the empty key and no target; a page without id is always a response.
    Rows that share an id are each written and judged by their own payload: a payload that a smaller id has is a revisit,
    any other a response (repeated rows are equal responses or equal revisits). An empty table writes nothing; other
    columns are ignored."""
    spark = pages.sparkSession
    folder = folder or C.new_path(spark, "warc")
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    source = source.select("*", F.sha1("payload").alias("sha"), F.length("payload").alias("size"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at, path = TaskContext.get().partitionId(), None, 0, ""
        where, base = fs.FileSystem.from_uri(folder)
        try:
            for b in C.text_steps(batches, column="payload"):
                rows = []
                for page_id, url, payload, sha, first in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "payload", "sha", "refers_to"))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        where.create_dir(base, recursive=True)
                        name = f"{task:06d}-{uuid.uuid4().hex}.warc.gz"  # no other attempt uses it
                        out, at, path = where.open_output_stream(f"{base}/{name}", compression=None), 0, f"{folder}/{name}"
                    own = base64.b32encode(bytes.fromhex(sha)).decode()
                    data = gzip.compress(record(page_id, url, payload, first, own), level, mtime=0)
                    out.write(data)
                    rows.append((url_key(url), page_id, own, "response" if first is None else "revisit", path, at, len(data)))
                    at += len(data)
                yield _captures(rows)
        finally:
            if out is not None:
                out.close()

    joined = source.join(firsts(source, least), ["page_id", "sha"], "left").select("page_id", "url", "payload", "sha", "refers_to")
    return C.saved(joined.mapInArrow(write, _CAPTURE), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _CAPTURE_NAMES)


def read_records(captures: DataFrame) -> DataFrame:
    """The records of captures, by range reads: page_id, payload_bytes, payload_digest (computed where the payload is
    stored), record_type, refers_to, url, payload. Captures are spread by the CHUNK_BYTES of the archive that they start
    in, and neighbouring ones are read together. Repeated captures are read each; none give no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int]] = []
        rows, size, name, file = [], 0, None, None

        def fetch() -> None:
            nonlocal name, file, size
            path, begin, end = held[0][0], held[0][1], held[-1][1] + held[-1][2]
            if path != name:
                if file is not None:
                    file.close()
                where, base = fs.FileSystem.from_uri(path)
                name, file = path, where.open_input_file(base)
            data = file.read_at(end - begin, begin)
            for _, at, length in held:
                r = parse(gzip.decompress(data[at - begin : at - begin + length]))
                if r["payload"] is not None:
                    r["payload_digest"], r["payload_bytes"] = digest(r["payload"]), len(r["payload"])
                    size += len(r["payload"])
                rows.append(r)
            held.clear()

        try:
            for b in batches:
                for path, at, length in zip(*(b.column(k).to_pylist() for k in ("path", "offset", "length"))):
                    if held and (path != held[0][0] or at != held[-1][1] + held[-1][2] or at + length - held[0][1] > CHUNK_BYTES):
                        fetch()
                    held.append((path, at, length))
                    if size > C.STEP_BYTES:
                        yield _records(rows)
                        rows, size = [], 0
            if held:
                fetch()
            if rows:
                yield _records(rows)
        finally:
            if file is not None:
                file.close()
        C.give_back()

    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    chunk = (F.col("offset") / CHUNK_BYTES).cast("long").alias("chunk")
    spread = captures.select("path", "offset", "length", chunk).repartition(C.partitions(captures.sparkSession), "path", "chunk")
    return spread.sortWithinPartitions("path", "offset").select("path", "offset", "length").mapInArrow(read, kind)


def _records(rows: list[dict]) -> pa.RecordBatch:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def members(path: str, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, one after the other."""
    where, base = fs.FileSystem.from_uri(path)
    with where.open_input_stream(base, compression=None) as f:
        inflate, held, rest = zlib.decompressobj(31), [], b""
        while True:
            data = rest or f.read(chunk)
            if not data:
                break
            held.append(inflate.decompress(data))
            rest = inflate.unused_data
            if inflate.eof:
                yield b"".join(held)
                inflate, held = zlib.decompressobj(31), []


def read_whole(path: str) -> bytes:
    where, base = fs.FileSystem.from_uri(path)
    with where.open_input_stream(base, compression=None) as f:
        return f.read()


def read_range(path: str, offset: int, length: int) -> bytes:
    where, base = fs.FileSystem.from_uri(path)
    with where.open_input_file(base) as f:
        return f.read_at(length, offset)


# ---- index -----------------------------------------------------------------------------------------------------------

_INDEX = "part int, first_key string, last_key string, path string, directory string, n_blocks long, n_lines long"
_INDEX_NAMES = ["part", "first_key", "last_key", "path", "directory", "n_blocks", "n_lines"]


def _place(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """What the index is sorted by: null ids first."""
    return key, page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes all captures in sorted, compressed blocks, a file and its directory for each stretch of keys, and returns
    the stretches: part, first_key and last_key (at most BOUND_CHARS characters), path, directory, n_blocks, n_lines.
    Captures of one key are ordered by id, null ids first, and may span blocks and stretches; none give no stretch."""
    spark = captures.sparkSession
    folder = folder or C.new_path(spark, "capture-index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, blocks, held = TaskContext.get().partitionId(), 0, [], []
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        name = f"{task:06d}-{uuid.uuid4().hex}"
        with where.open_output_stream(f"{base}/{name}.idx", compression=None) as f:

            def flush() -> None:
                nonlocal at
                data = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), 6)
                f.write(data)
                blocks.append([_place(*held[0][:2]), _place(*held[-1][:2]), at, len(data), len(held)])
                at += len(data)
                held.clear()

            for b in batches:
                for line in zip(*(b.column(k).to_pylist() for k in _CAPTURE_NAMES)):
                    held.append(line)
                    if len(held) == block_lines:
                        flush()
            if held:
                flush()
        if blocks:
            with where.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(blocks).encode(), 6))
            row = [task, blocks[0][0][0][:BOUND_CHARS], blocks[-1][1][0][:BOUND_CHARS], f"{folder}/{name}.idx", f"{folder}/{name}.dir", len(blocks), sum(x[4] for x in blocks)]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], _INDEX_NAMES)

    ordered = captures.select(*_CAPTURE_NAMES).repartitionByRange(C.partitions(spark), "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return C.saved(ordered.mapInArrow(write, _INDEX), "capture-stretches")


class _Stretch:
    """The directory of one stretch, and its last block."""

    def __init__(self, path: str, directory: str):
        self.path = path
        blocks = [(tuple(a), tuple(z), at, n) for a, z, at, n, _ in json.loads(zlib.decompress(read_whole(directory)))]
        self.firsts, self.lasts, self.ranges = [b[0] for b in blocks], [b[1] for b in blocks], [b[2:] for b in blocks]
        self.block, self.lines, self.places = -1, [], []

    def find(self, least: tuple, most: tuple) -> Iterator[list]:
        """Lines whose places lie between the two, both included."""
        for k in range(bisect_left(self.lasts, least), bisect_right(self.firsts, most)):
            if k != self.block:
                self.lines = [json.loads(x) for x in zlib.decompress(read_range(self.path, *self.ranges[k])).decode().split("\n")]
                self.block, self.places = k, [_place(*x[:2]) for x in self.lines]
            yield from self.lines[bisect_left(self.places, least) : bisect_right(self.places, most)]


class CaptureIndex:
    """The bounds of the stretches (some hundred bytes each, as many as the index has files), which is all that is held
    here; a stretch's directory is read when a lookup needs it."""

    def __init__(self, index: DataFrame):
        rows = sorted(tuple(r) for r in index.select("part", "first_key", "last_key", "path", "directory").collect())
        self.firsts, self.lasts, self.paths = [r[1] for r in rows], [r[2] for r in rows], [r[3:] for r in rows]

    def parts(self, key: str) -> range:
        """Stretches that may hold a key."""
        short = key[:BOUND_CHARS]
        return range(bisect_left(self.lasts, short), bisect_right(self.firsts, short))

    def captures(self, url: str) -> list[dict]:
        """All captures of a URL, by page id, null ids first."""
        key = url_key(url)
        found = (x for k in self.parts(key) for x in _Stretch(*self.paths[k]).find((key, False, 0), (key, True, 1 << 63)))
        return [dict(zip(_CAPTURE_NAMES, x)) for x in found]

    def payload(self, capture: dict) -> dict:
        """The record of a capture, by one range read."""
        return parse(gzip.decompress(read_range(capture["path"], capture["offset"], capture["length"])))


def page_keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """url_key and page_id of every row, as lookup() takes them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column("url").to_pylist()], pa.string()), b.column("page_id")], ["url_key", "page_id"])

    return pages.select(F.col(url_col).alias("url"), F.col(id_col).alias("page_id")).mapInArrow(make, "url_key string, page_id long")


def lookup(index: DataFrame, wanted: DataFrame, exact: bool = True) -> DataFrame:
    """The captures of wanted keys (url_key and, if exact, page_id), each once however often it is wanted; keys that the
    index does not have give nothing. Requests go to the stretch that may hold them and are answered there in order, so a
    block is read once."""
    top, names = CaptureIndex(index), ["url_key", "page_id"] if exact else ["url_key"]
    bounds = (top.firsts, top.lasts, top.paths)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, row = [], []
            for k, key in enumerate(b.column("url_key").to_pylist()):
                short = key[:BOUND_CHARS]
                for p in range(bisect_left(bounds[1], short), bisect_right(bounds[0], short)):
                    part.append(p)
                    row.append(k)
            some = b.take(pa.array(row, pa.int64())) if hasattr(b, "take") else pa.Table.from_batches([b]).take(pa.array(row, pa.int64())).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *some.columns], ["part", *names])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stretch, rows = -1, None, []
        for b in batches:
            for part, key, *own in zip(*(b.column(k).to_pylist() for k in ("part", *names))):
                if part != now:
                    now, stretch = part, _Stretch(*bounds[2][part])
                least, most = (_place(key, own[0]),) * 2 if exact else ((key, False, 0), (key, True, 1 << 63))
                for line in stretch.find(least, most):
                    rows.append(line)
                    if len(rows) == 10_000:
                        yield _captures(rows)
                        rows = []
        if rows:
            yield _captures(rows)
        C.give_back()

    kinds = "part int, url_key string" + (", page_id long" if exact else "")
    asked = wanted.select(*names).where(F.col("url_key").isNotNull()).distinct().mapInArrow(route, kinds)
    spread = asked.repartition(C.partitions(index.sparkSession), "part").sortWithinPartitions("part", *names)
    return spread.mapInArrow(answer, _CAPTURE)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS x FROM p),
d AS (SELECT page_id, n, x, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)::INTEGER, 1)), '') AS b FROM h),
f AS (SELECT x, min(page_id) AS first_id FROM d GROUP BY x)
SELECT d.page_id, d.n AS payload_bytes, d.b AS payload_digest,
  CASE WHEN d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM d JOIN f ON d.x = f.x
"""
