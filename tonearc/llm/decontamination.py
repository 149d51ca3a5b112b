"""Benchmark items in documents, re-parameterised ones too: template windows are joined by hash, slots are checked.

Numbers, names (capitalised words that no sentence starts with) and units after a number become typed placeholders;
neighbouring placeholders of a type become one. Every window of `window` template tokens of a document that an item
also has is a hit, if enough of its tokens are literal; items of fewer tokens are one window. What stands in the slots
of hits must fit: one value of the item always meets the same value of the document, and the other way round. Hits are
judged by placement (diagonal: place in the document minus place in the item), by runs of neighbouring placements, and
all together; a pair counts if any of these passes.

Items with windows of too few literal tokens are also looked for as they are: all windows of `window` lower-cased words
(A-Z), all words of items of fewer, joined by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearc.llm import common as C
from tonearc.llm.line_dedup import Bloom
from tonearc.llm.windows import FILTER_WINDOWS, Known, windows

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
UNITS = frozenset(b"km m cm mm mi mile miles ft feet foot inch inches yd kg g mg lb lbs oz l ml s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur dollar dollars cent cents euro euros percent degrees mph kmh kw kwh w v hz gb mb tb".split())
_WORD = np.array([48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: Hashes that hold this share of all hits or more are joined by broadcast; at most 1 / HOT_SHARE such hashes exist.
HOT_SHARE = 1 / 2000
#: Seed of words' hashes where they stand for themselves, so that they never meet template tokens.
_SALT = 1
_STOP = np.array([c in b".!?:\n" for c in range(256)])


def template(buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of all rows: (hash of the token, kind, hash of what stands there, first of each row and one more)."""
    n = int(rows[-1])
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = _WORD[buf[:n]]
    edge = np.diff(inside)
    begin, end = edge == 1, edge == -1
    cut = rows[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    begin[cut] = end[cut] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    first = np.searchsorted(starts, rows)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), first
    code, pieces = C.distinct_pieces(buf, starts, ends)
    low = [p.lower() if p.isascii() else p.decode("utf-8", "replace").lower().encode() for p in pieces]
    value = np.array([xxhash.xxh3_64_intdigest(p) for p in low], np.uint64)[code]
    number = np.array([p[0] in b"0123456789" for p in pieces])[code]
    upper = np.array([65 <= p[0] <= 90 or (p[0] >= 128 and p.decode("utf-8", "replace")[0].isupper()) for p in pieces])[code]
    unit = np.array([p in UNITS for p in low])[code]
    stops = np.concatenate([[0], np.cumsum(_STOP[buf[:n]])])
    sentence = np.ones(len(starts), bool)
    sentence[1:] = stops[starts[1:]] > stops[ends[:-1]]
    head = first[:-1][np.diff(first) > 0]
    sentence[head] = True
    kind = np.where(number, NUMBER, np.where(upper & ~sentence, NAME, LITERAL)).astype(np.int8)
    after = np.zeros(len(kind), bool)
    after[1:] = kind[:-1] == NUMBER
    after[head] = False
    kind[after & unit & (kind == LITERAL)] = UNIT
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == LITERAL)
    new[head] = True
    at = np.flatnonzero(new)
    kind, value = kind[at], np.add.reduceat(value, at)
    token = np.where(kind == LITERAL, value, kind.astype(np.uint64))
    return token, kind, value, np.searchsorted(at, first)


def _sized(values: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, size) of the windows of items: `window` tokens, or all tokens of an item of fewer."""
    count, out = np.diff(first), [np.zeros((3, 0), np.uint64)]
    for n in range(1, window + 1):
        at, h = windows(values, first, n)
        own = count[np.searchsorted(first, at, side="right") - 1]
        keep = own >= n if n == window else own == n
        out.append(np.array([at[keep].astype(np.uint64), h[keep], np.full(int(keep.sum()), n, np.uint64)]))
    at, h, n = np.concatenate(out, axis=1)
    return at.astype(np.int64), h, n.astype(np.int64)


def _items(batches: Iterator[pa.RecordBatch], least: float, window: int) -> Iterator[pa.RecordBatch]:
    """The windows of items (name, text): those of template tokens that are literal enough and, of items that have others
    as well, those of words as they are."""
    for step in C.text_steps(batches):
        buf, rows = C.text_bytes(step.column("text"))
        token, kind, value, first = template(buf, rows)
        at, h, size = _sized(token, first, window)
        literal, slot = np.concatenate([[0], np.cumsum(kind == LITERAL)]), np.flatnonzero(kind != LITERAL)
        keep = literal[at + size] - literal[at] >= least * size
        row = np.searchsorted(first, at, side="right") - 1
        partly = np.bincount(row[~keep], minlength=step.num_rows) > 0
        at, h, size, row = at[keep], h[keep], size[keep], row[keep]
        a, z = np.searchsorted(slot, at), np.searchsorted(slot, at + size)
        total = np.bincount(row, minlength=step.num_rows)[row]
        yield _rows(step.column("name"), row, at - first[row], h, value[slot[C.ragged(a, z - a)]].view(np.int64), C.prefix(z - a), total, size)
        low, starts, ends, first = C.words(buf, rows)
        code, pieces = C.distinct_pieces(low, starts, ends)
        if pieces:
            at, h, size = _sized(np.array([xxhash.xxh3_64_intdigest(p, _SALT) for p in pieces], np.uint64)[code], first, window)
            row = np.searchsorted(first, at, side="right") - 1
            keep = partly[row]
            at, h, size, row = at[keep], h[keep], size[keep], row[keep]
            total = np.bincount(row, minlength=step.num_rows)[row]
            yield _rows(step.column("name"), row, at - first[row], h, np.zeros(0, np.int64), np.zeros(len(at) + 1, np.int64), total, size, True)


def _found(column: pa.Array, sizes: list[int], least: float, known: Known | Bloom):
    """Windows of a column: (row, start, hash, slot values of each window, with the number of them)."""
    token, kind, value, first = template(*C.text_bytes(column))
    literal = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    slot = np.flatnonzero(kind != LITERAL)
    out = []
    for n in sizes:
        at, h = windows(token, first, n)
        keep = literal[at + n] - literal[at] >= least * n
        at, h = at[keep], h[keep]
        own = known.where(h)
        at, h = at[own], h[own]
        a, z = np.searchsorted(slot, at), np.searchsorted(slot, at + n)
        out.append((at, h, a, z))
    at, h, a, z = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    row = np.searchsorted(first, at, side="right") - 1
    return row, at - first[row], h, value[slot[C.ragged(a, z - a)]].view(np.int64), C.prefix(z - a), np.diff(first)


def _verbatim(column: pa.Array, sizes: list[int], known: Known | Bloom):
    """What _found gives, of windows of words as they are: no slots, all windows count."""
    low, starts, ends, first = C.words(*C.text_bytes(column))
    code, pieces = C.distinct_pieces(low, starts, ends)
    word = np.array([xxhash.xxh3_64_intdigest(p, _SALT) for p in pieces], np.uint64)[code]
    out = [np.zeros((2, 0), np.uint64)]
    for n in sizes:
        at, h = windows(word, first, n)
        own = known.where(h)
        at, h = at[own], h[own]
        out.append(np.array([at.astype(np.uint64), h]))
    at, h = np.concatenate(out, axis=1)
    at = at.astype(np.int64)
    row = np.searchsorted(first, at, side="right") - 1
    return row, at - first[row], h, np.zeros(0, np.int64), np.zeros(len(at) + 1, np.int64), np.diff(first)


_WINDOWS = "name long, at long, hash long, slots array<long>, total long, size int, verbatim boolean"


def _documents(batches: Iterator[pa.RecordBatch], sizes: dict[bool, list[int]], least: float, test: Known | Bloom) -> Iterator[pa.RecordBatch]:
    """The windows of documents (name, text) that the filter knows. sizes: of template windows and of verbatim ones."""
    for step in C.text_steps(batches):
        own = step.column("text")
        row, at, h, slots, begin, _ = _found(own, sizes[False], least, test)
        yield _rows(step.column("name"), row, at, h, slots, begin, 0, 0)
        if sizes[True]:
            row, at, h, slots, begin, _ = _verbatim(own, sizes[True], test)
            yield _rows(step.column("name"), row, at, h, slots, begin, 0, 0, True)


def _rows(names: pa.Array, row, at, h, slots, begin, total, size, verbatim: bool = False) -> pa.RecordBatch:
    full = lambda x, t: np.broadcast_to(np.asarray(x, t), len(at))
    cols = [names.take(pa.array(row)), pa.array(at), pa.array(h.view(np.int64)), C.lists(slots, begin, pa.int64()), pa.array(full(total, np.int64)), pa.array(full(size, np.int32)), pa.array(np.full(len(at), verbatim))]
    return pa.RecordBatch.from_arrays(cols, ["name", "at", "hash", "slots", "total", "size", "verbatim"])


def _filter(known: DataFrame, n: int) -> np.ndarray:
    """The items' hashes, or beyond FILTER_WINDOWS the bits of a Bloom filter of C.BROADCAST_BYTES at most, which is filled
    by tasks and joined by pairs of its rows: beyond its planned number it lets more windows through, never fewer."""
    if n <= FILTER_WINDOWS:
        return np.unique(known.select("hash").toArrow()["hash"].to_numpy()).view(np.uint64)
    keys = min(n, C.BROADCAST_BYTES // 4)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(keys)
        for b in batches:
            own.add(b.column("hash").to_numpy())
        # By stretches, so that the filters of tasks meet in aggregates of 1 KB rows and never all in one place.
        parts = own.bits.reshape(-1, 1024) if len(own.bits) >= 1024 else own.bits[None]
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, bits in zip(b.column("part").to_pylist(), b.column("bits").to_pylist()):
                own = np.frombuffer(bits, np.uint8)
                held[k] = held[k] | own if k in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    filled = known.select("hash").mapInArrow(fill, "part long, bits binary").repartition(C.partitions(known.sparkSession), "part").mapInArrow(join, "part long, bits binary")
    bits = Bloom(keys).bits
    for r in filled.collect():  # the filter, C.BROADCAST_BYTES at most
        bits[r.part * 1024 : r.part * 1024 + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return bits


def _hits(mine: DataFrame, theirs: DataFrame, few: bool) -> DataFrame:
    """Windows of documents joined to those of items by hash: by broadcast if the items' windows are few bytes; else those
    of hot hashes by broadcast (a thousandth of all items' windows at most, checked as well) and the others by a shuffle."""
    if few:
        return mine.join(F.broadcast(theirs), "hash")
    mine = C.saved(mine, "document-windows")
    n = mine.count()
    hot = C.saved(mine.groupBy("hash").count().where(F.col("count") >= max(2, int(n * HOT_SHARE))).select("hash"), "hot-hashes")
    big = theirs.join(F.broadcast(hot), "hash")  # 1 / HOT_SHARE rows of 8 bytes
    small = (big.agg(F.sum(F.size("slots") * 8 + 80)).first()[0] or 0) <= C.BROADCAST_BYTES
    one = mine.join(F.broadcast(hot), "hash")
    one = one.join(F.broadcast(big) if small else big, "hash")
    return one.unionByName(mine.join(F.broadcast(hot), "hash", "left_anti").join(theirs, "hash").select(*one.columns))


def contaminated(docs: DataFrame, items: DataFrame, window: int = 8, literal: float = 0.5, coverage: float = 0.3, consistency: float = 0.9, drift: int = 3, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id) where a placement, a run of placements at most `drift` tokens apart, or all hits together
    hold at least a share `coverage` of the item's windows, with consistent slots; of the one that passes (exact ones
    first, then that of most windows): n_windows (of the item, found), coverage, consistency, exact (all slots hold the item's own
    values), first_token and last_token (template tokens of the document).

    A pair found by the words as they are alone has windows and places of words instead of template tokens, and is exact.
    A null or empty text matches nothing, nor does an item without a word; null ids are not
    reported; rows that share an id count as one document; empty tables give no rows; other columns are ignored."""
    spark = docs.sparkSession
    source = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("name"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    known = C.saved(source.mapInArrow(lambda b: _items(b, literal, window), _WINDOWS), "item-windows")
    found = known.select("size", "verbatim").distinct().collect()  # window sizes: `window` at most
    sizes = {v: sorted(r["size"] for r in found if r["verbatim"] == v) for v in (False, True)}
    text = C.id_and_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "name")
    shape = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("slots") * 8 + 80).alias("size")).first()
    shared = spark.sparkContext.broadcast(_filter(known, shape.n))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        return _documents(batches, sizes, literal, Known(own) if own.dtype == np.uint64 else Bloom(0, own))

    mine = text.mapInArrow(make, _WINDOWS).select(F.col("name").alias("doc_id"), F.col("at").alias("doc_at"), "hash", F.col("slots").alias("doc_slots"))
    theirs = known.select(F.col("name").alias("item_id"), F.col("at").alias("item_at"), "hash", "slots", "total", "verbatim")
    hits = _hits(mine, theirs, (shape.size or 0) <= C.BROADCAST_BYTES).withColumn("diagonal", F.col("doc_at") - F.col("item_at"))
    pair = ["doc_id", "item_id"]
    order = Window.partitionBy(*pair, "verbatim").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > drift).cast("int"), F.lit(0))
    merged = hits.withColumn("new", new).withColumn("run", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    parts = F.array(F.lit("all"), F.concat(F.lit("run "), F.col("run").cast("string")), F.concat(F.lit("at "), F.col("diagonal").cast("string")))
    hits = C.saved(merged.withColumn("part", F.explode(parts)).drop("new", "run", "diagonal"), "item-hits")
    part = [*pair, "verbatim", "part"]
    found = hits.groupBy(*part).agg(F.countDistinct("item_at").alias("n_windows"), F.max("total").alias("total"), F.min("doc_at").alias("first_token"), F.max("doc_at").alias("last_token"))
    found = found.withColumn("coverage", F.col("n_windows") / F.col("total")).where(F.col("coverage") >= coverage)
    slots = hits.where(F.size("slots") > 0).select(*part, F.explode(F.arrays_zip(F.col("slots").alias("theirs"), F.col("doc_slots").alias("mine"))).alias("s")).select(*part, "s.theirs", "s.mine").distinct()
    fit = slots.groupBy(*part).agg((F.least(F.countDistinct("theirs"), F.countDistinct("mine")) / F.count(F.lit(1))).alias("consistency"), F.min((F.col("theirs") == F.col("mine")).cast("int")).alias("own"))
    out = found.join(fit, part, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= consistency)
    out = out.withColumn("exact", F.coalesce(F.col("own"), F.lit(1)) == 1)
    best = F.max_by(F.struct("n_windows", "coverage", "consistency", "exact", "first_token", "last_token"), F.struct("exact", ~F.col("verbatim"), "n_windows", "consistency", "part")).alias("best")
    return out.groupBy(*pair).agg(best).select(*pair, "best.*")
