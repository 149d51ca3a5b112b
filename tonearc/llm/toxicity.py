"""Toxicity by two class-conditional Kneser-Ney models of the letters of words.

Each class has its own counts of letter n-grams of the highest order; below them both back off to the same continuation
counts, so an expression that neither class has seen costs both alike, and what tells the classes apart is where one of
them has evidence. Letters are reduced to 32 symbols (a-z, digits, word boundary, four for other letters).

N-grams are counted over all labelled documents that may be learnt from, and all of them stay in the model, which is a
table: n-grams go to buckets by the SHARED letters before the last, so that all that n-grams of more than SHARED letters
need is in one bucket. The continuation counts of SHARED letters and fewer (32^4 rows at most, the alphabet's own size)
are counted over the whole table and broadcast. Documents are handled a block at a time: a block asks each bucket once
for its distinct n-grams, and sums up the answers for its words.

A document's evidence: the length-normalised difference of its log-likelihoods, the largest difference of a single
expression, and the sum of the large ones. A logistic model of these three, fitted on labelled documents that the
n-grams were not counted on, gives the score.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearc.llm import common as C

ORDER, SYMBOLS, SHARED = 8, 32, 4
_BITS = 5
#: Ratios are added up as whole numbers of 1 / SCALE, so that sums do not depend on the order.
SCALE = 1 << 24
#: Bytes of text in a block of documents.
BLOCK_BYTES = 14 << 20
#: First bytes of longer UTF-8 letters count for nothing, the bytes after them as one of four symbols.
_SYMBOL = np.array([b - 96 if 97 <= b <= 122 else 27 if 48 <= b <= 57 else 28 + b % 4 if 128 <= b < 192 else 0 for b in range(256)], np.int64)
#: Labels up to this number of rows are broadcast to the documents, more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


# ---- model -----------------------------------------------------------------------------------------------------------


def grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of words that end in a letter or in the boundary after the word: (packed n-grams, index of word), and
    the letters of each word, its end included."""
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    keep = flat < 192
    size = np.bincount(owner[keep], minlength=len(pieces))
    first = C.prefix(size + ORDER)
    letters = np.zeros(int(first[-1]), np.int64)
    letters[C.ragged(first[:-1] + ORDER - 1, size)] = _SYMBOL[flat[keep]]
    packed = letters.copy()
    for k in range(1, ORDER):
        packed[k:] |= letters[:-k] << _BITS * k
    return packed[C.ragged(first[:-1] + ORDER - 1, size + 1)], np.repeat(np.arange(len(pieces)), size + 1), size + 1


def _last(gram, n: int):
    """The last n letters (of an array or a column)."""
    mask = (1 << _BITS * n) - 1
    return gram.bitwiseAND(mask) if isinstance(gram, Column) else gram & mask


def _bucket(gram, buckets: int):
    """Bucket of n-grams (of an array or a column), by the SHARED letters before the last, which are scattered."""
    context = _last(F.shiftright(gram, _BITS) if isinstance(gram, Column) else gram >> _BITS, SHARED)
    return (context * 0x9E3779B1 % 4294967291 % buckets).cast("int") if isinstance(gram, Column) else context * 0x9E3779B1 % 4294967291 % buckets


def _levels(own: np.ndarray, n: int, least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of own's endings of n, n - 1, ... least letters: (distinct endings, index of each of the level before, how many
    of the level before end so)."""
    out = []
    for k in range(n, least - 1, -1):
        own, where, many = C.distinct(_last(own, k))
        out.append((own, where, many))
    return out


def _smooth(levels: list, p: np.ndarray, below: np.ndarray, discount: float) -> np.ndarray:
    """Probabilities of the last letters of the level before levels[0], out of p[below] for the last level's backoff."""
    for own, where, many in reversed(levels):
        _, group, kinds = C.distinct(own >> _BITS)
        total = np.bincount(group, weights=many)[group]
        p = np.maximum(many - discount, 0) / total + discount * kinds[group] / total * p[below]
        below = where
    return p[below]


def shared_backoff(own: np.ndarray, many: np.ndarray, discount: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of SHARED letters ascending, probability of the last letter of each) from their continuation counts."""
    order = np.argsort(own)
    own, many = own[order], many[order]
    if not len(own):
        return own, np.zeros(0)
    levels = [(own, np.arange(len(own)), many), *_levels(own, SHARED - 1, 1)]
    return own, _smooth(levels, np.full(1, 1 / SYMBOLS), np.zeros(len(levels[-1][0]), np.int64), discount)


class Ratio:
    """log p(last letter | those before, toxic) - log p(last letter | those before, ordinary)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float = 0.75, shared: tuple[np.ndarray, np.ndarray] | None = None):
        """keys: distinct packed n-grams; counts: [ordinary, toxic] of each. With shared (of shared_backoff), the keys
        may be part of a model: all those whose SHARED letters before the last are among theirs."""
        order = np.argsort(keys)
        self.keys, counts = keys[order], counts[:, order]
        self.heads, head, _ = C.distinct(self.keys >> _BITS)
        if not len(keys):
            self.seen = self.unseen = np.zeros(0, np.float32)
            return
        # Continuation counts, shared by the classes: of each shorter n-gram, how many letters come before it.
        if shared is None:
            levels = _levels(self.keys, ORDER - 1, 1)
            p, below = np.full(1, 1 / SYMBOLS), np.zeros(len(levels[-1][0]), np.int64)
        else:
            levels = _levels(self.keys, ORDER - 1, SHARED + 1)
            p, below = shared[1], np.searchsorted(shared[0], _last(levels[-1][0], SHARED))
        p = _smooth(levels, p, below, discount)
        logs, rests = [], []
        for n in counts:
            total, kinds = np.bincount(head, weights=n), np.bincount(head, weights=n > 0)
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            rests.append(np.log(rest))
            logs.append(np.log(np.maximum(n - discount, 0) / np.maximum(total, 1)[head] + rest[head] * p))
        self.seen, self.unseen = (logs[1] - logs[0]).astype(np.float32), (rests[1] - rests[0]).astype(np.float32)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        """An n-gram that was not counted differs by what the classes leave to the backoff after its letters."""
        if not len(self.keys):
            return np.zeros(len(gram), np.float32)
        at = np.minimum(np.searchsorted(self.keys, gram), len(self.keys) - 1)
        out, rest = self.seen[at], np.flatnonzero(self.keys[at] != gram)
        head = gram[rest] >> _BITS
        at = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        out[rest] = np.where(self.heads[at] == head, self.unseen[at], 0)
        return out


_GRAM = pa.schema([("gram", pa.int64()), ("ordinary", pa.int64()), ("toxic", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of each class, added up over some documents at a time."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []  # (bytes of text, n-grams, counts), larger ones first

    def merge() -> None:
        (a, keys, n), (b, more, m) = held[-2:]
        own, which, _ = C.distinct(np.concatenate([keys, more]))
        both = np.concatenate([n, m], axis=1)
        held[-2:] = [(a + b, own, np.array([np.bincount(which, weights=x, minlength=len(own)) for x in both]).astype(np.int64))]

    for step in C.text_steps(batches):
        buf, rows = C.text_bytes(step.column("text"))
        low, starts, ends, first = C.words(buf, rows)
        code, pieces = C.distinct_pieces(low, starts, ends)
        if not pieces:
            continue
        toxic = np.repeat(step.column("toxic").to_numpy(zero_copy_only=False), np.diff(first))
        gram, word, _ = grams(pieces)
        keys, which, _ = C.distinct(gram)
        n = np.array([np.bincount(which, weights=np.bincount(code[toxic == k], minlength=len(pieces))[word]) for k in range(2)]).astype(np.int64)
        held.append((int(rows[-1]), keys, n))
        while len(held) > 1 and held[-1][0] >= held[-2][0]:
            merge()
        if held[0][0] >= BLOCK_BYTES:
            while len(held) > 1:
                merge()
            yield C.batch(_GRAM, held[0][1], *held[0][2])
            held.clear()
    while len(held) > 1:
        merge()
    if held:
        yield C.batch(_GRAM, held[0][1], *held[0][2])


def ratios(counted: DataFrame, requests: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, answer (ratios in 1 / SCALE) to requests (block, bucket, grams: ascending) by the model of counted
    (gram, ordinary, toxic; each n-gram once)."""
    spark = counted.sparkSession
    fives = counted.select(_last(F.col("gram"), SHARED + 1).alias("gram")).distinct()
    fours = fives.groupBy(_last(F.col("gram"), SHARED).alias("gram")).count().toArrow()  # SYMBOLS ** SHARED rows at most
    base = spark.sparkContext.broadcast(shared_backoff(fours["gram"].to_numpy(), fours["count"].to_numpy()))

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        ratio = Ratio(known["gram"].to_numpy(), np.array([known["ordinary"].to_numpy(), known["toxic"].to_numpy()]), shared=base.value)
        out = []
        for blob in asked["grams"]:
            low, high = _loose(blob.as_py())
            got = np.rint(ratio(np.cumsum(low | high << 32)).astype(float) * SCALE).astype(np.int64)
            out.append(_planes(got + (1 << 31)))  # ratios are far below 128
        del ratio
        C.give_back()
        return pa.table([asked["block"], asked["bucket"], pa.array(out, pa.binary())], ["block", "bucket", "answer"])

    mine = counted.withColumn("bucket", _bucket(F.col("gram"), buckets)).groupBy("bucket")
    return mine.cogroup(requests.groupBy("bucket")).applyInArrow(answer, "block string, bucket int, answer binary")


_EVIDENCE = ["mean_ratio", "most", "large"]
_BLOCK = pa.schema([("block", pa.string()), ("words", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("letters", pa.list_(pa.int64())), ("terms", pa.binary())])


def _planes(a: np.ndarray) -> bytes:
    """Numbers under 2^32, compressed with low bytes apart from high ones, after the size."""
    out = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    return len(out).to_bytes(4, "little") + out


def _loose(blob: bytes) -> Iterator[np.ndarray]:
    """What _planes made, one after the other."""
    while blob:
        n = int.from_bytes(blob[:4], "little")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 : 4 + n]), np.uint8)
        yield np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        blob = blob[4 + n :]


class _Block:
    """Distinct words of the steps so far, and their frequencies in documents."""

    def __init__(self):
        self.code: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.letters: list[np.ndarray] = []
        self.terms: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, step: pa.RecordBatch) -> None:
        buf, rows = C.text_bytes(step.column("text"))
        low, starts, ends, first = C.words(buf, rows)
        code, pieces = C.distinct_pieces(low, starts, ends)
        own = np.array([self.code.setdefault(p, len(self.code)) for p in pieces], np.int64)
        size = np.array([sum(c < 192 for c in p) + 1 for p in pieces], np.int64)
        doc = np.repeat(np.arange(len(rows) - 1), np.diff(first))
        self.letters.append(np.bincount(doc, weights=size[code] if len(size) else None, minlength=len(rows) - 1).astype(np.int64))
        pair, n = np.unique(doc << 32 | (own[code] if len(own) else code), return_counts=True)
        term, per_doc = pair & 0xFFFFFFFF, np.bincount(pair >> 32, minlength=len(rows) - 1)
        step_by = np.diff(term, prepend=0)  # terms of a document ascend: differences
        head = C.prefix(per_doc)[:-1][per_doc > 0]
        step_by[head] = term[head]
        self.terms.append((per_doc, step_by, n))
        self.ids += step.column("doc_id").to_pylist()
        self.size += int(rows[-1])

    def row(self) -> pa.RecordBatch:
        terms = b"".join(_planes(np.concatenate(x)) for x in zip(*self.terms))
        return C.batch(_BLOCK, [uuid.uuid4().hex], [zstandard.ZstdCompressor(level=3).compress(b" ".join(self.code))], pa.array([self.ids], pa.list_(pa.int64())), pa.array([np.concatenate(self.letters)], pa.list_(pa.int64())), [terms])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for step in C.text_steps(batches):
        block.add(step)
        if block.size >= BLOCK_BYTES:
            row, block = block.row(), _Block()
            C.give_back()
            yield row
    if block.ids:
        yield block.row()


def _spelled(words: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a block: (distinct n-grams by bucket, ascending in each; where each bucket starts, one more than
    buckets; the place there of each n-gram of each word; the word of each)."""
    gram, word, _ = grams(zstandard.ZstdDecompressor().decompress(words).split())
    own, which, _ = C.distinct(gram)
    bucket = _bucket(own, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    return own[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[which], word


def evidence(docs: DataFrame, counted: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: float = 3.0) -> DataFrame:
    """doc_id, mean_ratio (a letter), most, large of every row by the n-grams in counted (gram, ordinary, toxic; each
    n-gram once); a text without words has 0 in all three."""
    buckets = C.partitions(docs.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words in zip(b.column("block").to_pylist(), b.column("words").to_pylist()):
                own, first, _, _ = _spelled(words, buckets)
                some = np.flatnonzero(np.diff(first))
                steps = [np.diff(own[first[k] : first[k + 1]], prepend=0) for k in some.tolist()]
                blobs = [_planes(x & 0xFFFFFFFF) + _planes(x >> 32) for x in steps]
                del own, steps
                C.give_back()
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["block", "bucket", "grams"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = round(large * SCALE)
        for b in batches:
            for ids, letters, words, blob, answers in zip(*(b.column(c) for c in ("doc_id", "letters", "words", "terms", "answers"))):
                per_doc, term, n = _loose(blob.as_py())
                out = np.zeros((3, len(per_doc)))
                if len(term):
                    found = sorted((x["bucket"], x["answer"]) for x in answers.as_py())
                    ratio = np.concatenate([next(_loose(x)) for _, x in found]) - (1 << 31)
                    _, _, place, word = _spelled(words.as_py(), buckets)
                    own = np.add.reduceat(ratio[place], np.flatnonzero(np.diff(word, prepend=-1)))
                    del found, ratio, place, word
                    some = np.flatnonzero(per_doc)
                    begin = C.prefix(per_doc)[some]
                    run = np.cumsum(term)
                    own = own[run - np.repeat(run[begin] - term[begin], per_doc[some])]
                    out[0, some] = np.add.reduceat(own * n, begin) / SCALE / letters.values.to_numpy()[some]
                    out[1, some] = np.maximum.reduceat(own, begin) / SCALE
                    out[2, some] = np.log1p(np.add.reduceat(np.maximum(own - least, 0) * n, begin) / SCALE)
                C.give_back()
                yield pa.RecordBatch.from_arrays([ids.values, *map(pa.array, out)], ["doc_id", *_EVIDENCE])

    made = C.saved(C.id_and_text(docs, id_col, text_col).mapInArrow(blocks, "block string, words binary, doc_id array<long>, letters array<long>, terms binary"), "toxic-blocks")
    requests = made.select("block", "words").mapInArrow(ask, "block string, bucket int, grams binary")
    answers = ratios(counted, requests, buckets).groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    return made.join(answers, "block", "left").mapInArrow(score, "doc_id long, mean_ratio double, most double, large double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights on the raw columns of x, the constant last, by Newton's method on standardised columns."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1)
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / sd
    return np.append(raw, w[-1] - raw @ mean)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, calibration_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, the three kinds of evidence, score (0 to 1), predicted (score >= threshold) of every row.

    labels: (id, 0 or 1). Documents of folds 0 and 1 are counted, up to calibration_rows of fold 3 (those of smallest
    hash of the id) fit the logistic model, fold 2 is never used. A null label is none; an id labelled twice counts with
    its largest label; a null text counts as empty; without labels of both classes every score is the share of label 1
    (0 without labels). Ties and repeated rows score alike; an empty table gives no rows; other columns are ignored."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).where(fold(F.col("doc_id")) != 2)
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    n, k = stats.n, stats.k or 0
    small = F.broadcast if n <= BROADCAST_LABELS else (lambda df: df)
    text = C.id_and_text(docs, id_col, text_col)
    train = text.join(small(known.where(fold(F.col("doc_id")).isin(0, 1))), "doc_id").select("text", "toxic")
    tally = train.mapInArrow(_count, "gram long, ordinary long, toxic long").groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    scored = C.saved(evidence(text, C.saved(tally, "letter-counts")), "toxic-evidence")
    sample = scored.join(small(known.where(fold(F.col("doc_id")) == 3)), "doc_id").orderBy(F.xxhash64("doc_id"), *_EVIDENCE).limit(calibration_rows).toArrow()
    y = sample["toxic"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        w = logistic(np.column_stack([sample[c].to_numpy() for c in _EVIDENCE]), y)
    else:
        share = min(max(k / n if n else 0.0, 0.0), 1.0)
        return scored.withColumn("score", F.lit(float(share))).withColumn("predicted", F.lit(int(share >= threshold)))
    z = sum((F.col(c) * float(a) for c, a in zip(_EVIDENCE, w[:-1])), F.lit(float(w[-1])))
    out = scored.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
