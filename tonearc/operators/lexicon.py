"""Polarity lexicons: glob matching on word types, valence shifters, n-gram scores."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearc.functions import ragged
from tonearc.functions.shared import saved
from tonearc.functions.special import cached_stem, glob_regex
from tonearc.operators.corpus import token_lists

LEVELS = ("negative", "neutral", "positive")


def levels(categories: list[str], n_sentiments: int) -> list[str]:
    """Categories that a model of n sentiments uses, in order."""
    own = [c for c in categories if not c.startswith("valence_")]
    if n_sentiments == 2 and {"negative", "positive"} <= set(own):
        return ["negative", "positive"]
    if n_sentiments == 3 and set(own) <= set(LEVELS):
        return list(LEVELS)
    if len(own) == n_sentiments:
        return own
    raise ValueError(f"lexicon of {len(own)} categories for {n_sentiments} sentiments")


def match(vocab: DataFrame, lexicon: dict[str, list[str]], use: list[str]) -> DataFrame:
    """vocab with lex: the one category whose patterns match the word, else null (also if several match)."""
    hits = [F.coalesce(globbed(F.lower("word"), lexicon.get(c) or []), F.lit(False)) for c in use]
    many = sum((h.cast("int") for h in hits), F.lit(0))
    named = F.coalesce(F.lit(None).cast("string"), *[F.when(h, F.lit(c)) for c, h in zip(use, hits)])
    return vocab.withColumn("lex", F.when(many == 1, named))


def globbed(word: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches the lower-cased word: by its start or end where a pattern has one * there."""
    found = F.lit(False)
    for p in (p.lower() for p in patterns):
        rest = p.strip("*")
        if "*" in rest or "?" in rest or len(p) - len(rest) > 1:
            found |= word.rlike(glob_regex(p))
        else:
            found |= word == rest if p == rest else word.startswith(rest) if p.endswith("*") else word.endswith(rest)
    return found


def compound(tokens: DataFrame, lexicon: dict[str, list[str]], use: list[str]) -> DataFrame:
    """(doc_id, pos, word, lex, compounded): negator [amplifier] polar-word become one token at the negator's place, of
    opposite polarity. All compounds of three words are made first, then those of two of what is left, both from left to
    right: a word that is used up starts none. Only the last word's matched category counts. One shuffle, by document."""
    lists = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t"))
    kinds = dict(tokens.dtypes)
    return _compound(lists.select("doc_id", F.col("t.word").alias("words"), F.col("t.pos").alias("places")), lexicon, use, kinds["doc_id"], kinds["pos"])


def compound_texts(docs: DataFrame, lexicon: dict[str, list[str]], use: list[str]) -> DataFrame:
    """compound() of a table's texts (doc_id, text): a document is read where it lies, without any shuffle."""
    return _compound(token_lists(docs), lexicon, use, dict(docs.dtypes)["doc_id"], "int")


def _globs(patterns: list[str]):
    """Whether words match one of the patterns."""
    some = re.compile("|".join(glob_regex(p) for p in patterns), re.DOTALL) if patterns else None
    return lambda words: np.array([some is not None and some.search(w) is not None for w in words], bool)


def _compound(lists: DataFrame, lexicon: dict[str, list[str]], use: list[str], key: str, place: str) -> DataFrame:
    """Of lists (doc_id, words [, places])."""
    names = [*use, "negative", "positive"]

    def read(batches):
        own, neg_of, amp_of = [_globs(lexicon.get(c) or []) for c in use], _globs(lexicon.get("valence_negator") or []), _globs(lexicon.get("valence_amplifier") or [])
        for b in (x for batch in batches for x in ragged.pieces(batch, "words")):
            bounds, words = ragged.flat(b, "words")
            code, distinct = ragged.coded(words)
            low = [w.lower() for w in distinct]
            hits = np.array([f(low) for f in own]).reshape(len(use), len(low))
            lex = np.append(np.where(hits.sum(axis=0) == 1, hits.argmax(axis=0), -1), -1)  # the last is what code -1 finds
            polar = np.array([c in ("negative", "positive") for c in use] + [False])[lex]
            neg, amp = np.append(neg_of(low), False)[code], np.append(amp_of(low), False)[code]
            n, p, left = len(code), polar[code], np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(code))
            ahead = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, n), bool)])
            three = np.flatnonzero(neg & ahead(amp, 1) & ahead(p, 2) & (left > 2))
            three = three[ragged.in_turn(three, np.full(len(three), 3))]
            used = np.zeros(n + 2, bool)
            for k in range(3):
                used[three + k] = True
            two = np.flatnonzero(neg & ahead(p, 1) & (left > 1) & ~used[:n] & ~used[1 : n + 1])
            two = two[ragged.in_turn(two, np.full(len(two), 2))]
            heads, tails = np.concatenate([three, two]), np.concatenate([three + 2, two + 1])
            keep = np.ones(n, bool)
            for inside in (three + 1, three + 2, two + 1):
                keep[inside] = False
            kind = lex[code]
            back, made = np.unique(code[tails], return_inverse=True)
            out, many = code.copy(), np.zeros(n, bool)
            out[heads], many[heads] = len(distinct) + made, True
            kind[heads] = np.where(np.array([names[k] == "positive" for k in kind[tails]], bool), len(use), len(use) + 1) if len(heads) else 0
            all_words = pa.array(distinct + ["#NEG#__" + distinct[k] for k in back.tolist()], pa.string())
            named = lambda codes, values: values.take(pa.array(codes[keep], mask=codes[keep] < 0))
            ids = b.column("doc_id").take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(bounds))[keep]))
            at = b.column("places").flatten().filter(pa.array(keep)) if "places" in b.schema.names else pa.array((np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds)))[keep].astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, at, named(out, all_words), named(kind, pa.array(names, pa.string())), pa.array(many[keep])], ["doc_id", "pos", "word", "lex", "compounded"])

    return lists.mapInArrow(read, f"doc_id {key}, pos {place}, word string, lex string, compounded boolean")


def stemmed_lists(lists: DataFrame) -> DataFrame:
    """Lists (doc_id, words) with stems for words; each distinct word of a piece is stemmed once."""

    def stems(batches):
        for b in (x for batch in batches for x in ragged.pieces(batch, "words")):
            bounds, words = ragged.flat(b, "words")
            code, distinct = ragged.coded(words)
            out = pa.array([cached_stem(w) for w in distinct], pa.string()).take(pa.array(code, mask=code < 0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), out)], ["doc_id", "words"])

    return lists.select("doc_id", "words").mapInArrow(stems, f"doc_id {dict(lists.dtypes)['doc_id']}, words array<string>")


#: Phrases of a lexicon up to which every worker holds their hashes (12 bytes each); beyond, phrases are read in rounds.
PHRASES = 8_000_000


def _phrases(docs: DataFrame, own: DataFrame, min_ngram: int, stemmed: bool) -> DataFrame:
    """(doc_id, times, and the columns of own): how often a reader from left to right takes each phrase of own in a
    document. Documents are read where they lie, with hashes of 95 bits for the phrases; only what they take is shuffled,
    a row for each document and phrase. A lexicon beyond PHRASES is handed out in parts: a part's hits are kept as places
    first, and read in turn together."""
    spark, key = docs.sparkSession, dict(docs.dtypes)["doc_id"]

    def hashed(batches):
        for b in batches:
            words = [w.split(" ") for w in b.column("keyword").to_pylist()]
            fits = np.array([len(w) == n for w, n in zip(words, b.column("ngram").to_pylist())], bool)
            h, g = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
            for n in {len(w) for w in words}:
                at = np.array([k for k, w in enumerate(words) if len(w) == n])
                for out, seed in ((h, 1), (g, 2)):
                    out[at] = ragged.joined_hash([ragged.one_hash([words[k][i] for k in at], seed) for i in range(n)])
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(pa.array(fits)) for c in b.schema.names), pa.array(h.view(np.int64)[fits]), pa.array((g & np.uint64(0x7FFFFFFF)).astype(np.int32)[fits])], [*b.schema.names, "_h", "_g"])

    known = saved(own.mapInArrow(hashed, own.schema.simpleString()[7:-1].replace(":", " ") + ", _h long, _g int"), "phrases")
    size = known.agg(F.count(F.lit(1)), F.max("ngram")).first()
    longest, parts = size[1] or min_ngram, -(-size[0] // PHRASES) or 1

    def handed(part: int):
        t = (known if parts == 1 else known.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part)).select("_h", "_g").toArrow()
        h, g = (t.column(c).to_numpy() for c in ("_h", "_g"))
        order = np.argsort(h.view(np.uint64))
        return spark.sparkContext.broadcast((h.view(np.uint64)[order], g[order]))

    def reader(table, places: bool):
        def read(batches):
            keys, checks = table.value
            for b in (x for batch in batches for x in ragged.pieces(batch, "words")):
                bounds, words = ragged.flat(b, "words")
                code, distinct = ragged.coded(words)
                if stemmed:
                    distinct = [cached_stem(w) for w in distinct]
                one, two = (ragged.one_hash(distinct, seed)[code] if distinct else np.zeros(0, np.uint64) for seed in (1, 2))
                left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(code))
                span, h, g = np.zeros(len(code), np.int32), np.zeros(len(code), np.uint64), np.zeros(len(code), np.int32)
                for n in range(min_ngram, longest + 1):  # the longest comes last
                    at = np.flatnonzero(left >= n)
                    x = ragged.joined_hash([one[at + k] for k in range(n)])
                    found = np.searchsorted(keys, x)
                    hit = np.zeros(len(at), bool)
                    inside = found < len(keys)
                    hit[inside] = keys[found[inside]] == x[inside]
                    at, x, found = at[hit], x[hit], found[hit]
                    y = (ragged.joined_hash([two[at + k] for k in range(n)]) & np.uint64(0x7FFFFFFF)).astype(np.int32)
                    same = checks[found] == y
                    span[at[same]], h[at[same]], g[at[same]] = n, x[same], y[same]
                start = np.flatnonzero(span)
                doc = np.repeat(np.arange(b.num_rows), np.diff(bounds))
                if places:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc[start])), pa.array((start - bounds[doc[start]]).astype(np.int32)), pa.array(span[start]), pa.array(h[start].view(np.int64)), pa.array(g[start])], ["doc_id", "pos", "span", "_h", "_g"])
                    continue
                start = start[ragged.in_turn(start, span[start])]
                order = np.lexsort((h[start], doc[start]))
                d, x, y = doc[start][order], h[start][order], g[start][order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])) if len(d) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(d[first])), pa.array(x[first].view(np.int64)), pa.array(y[first]), pa.array(np.diff(np.append(first, len(d))))], ["doc_id", "_h", "_g", "times"])

        return read

    lists = token_lists(docs)
    if parts == 1:
        taken = lists.mapInArrow(reader(handed(0), False), f"doc_id {key}, _h long, _g int, times long")
    else:
        some = [saved(lists.mapInArrow(reader(handed(p), True), f"doc_id {key}, pos int, span int, _h long, _g int"), "places") for p in range(parts)]
        every = some[0]
        for one in some[1:]:
            every = every.unionByName(one)

        def turn(batches):
            for b in batches:
                starts = [sorted({p["pos"]: p for p in sorted(s, key=lambda p: p["span"])}.values(), key=lambda p: p["pos"]) for s in b.column("s").to_pylist()]
                rows = [(d, p["_h"], p["_g"]) for d, s in zip(b.column("doc_id").to_pylist(), starts) for p, ok in zip(s, ragged.in_turn(np.array([p["pos"] for p in s]), np.array([p["span"] for p in s]))) if ok]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field("doc_id").type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([1] * len(rows), pa.int64())], ["doc_id", "_h", "_g", "times"])

        taken = every.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "span", "_h", "_g")).alias("s")).mapInArrow(turn, f"doc_id {key}, _h long, _g int, times long")
    return taken.join(known, ["_h", "_g"]).drop("_h", "_g")


def ngram_scores(docs: DataFrame, lexicon: DataFrame, min_ngram: int = 2, parent_col: str = "doc_id", per_word: bool = False, stemmed: bool = True) -> DataFrame:
    """Monetary-policy and economic-condition scores of each segment (doc_id): sums of (rest - acco) and (posi - nega)
    over matched phrases, divided by the mean, over the segments of the same parent, of the sums of all class weights,
    kept away from 0. lexicon: keyword, ngram, mp_acco, mp_neut, mp_rest, ec_nega, ec_neut, ec_posi; with stemmed, its
    keywords are stems, as the texts' words become. per_word: a row per segment and phrase.

    Texts are read from left to right; at each word the longest phrase is taken, and its words start no other."""
    own = saved(lexicon.where(F.col("ngram") >= min_ngram).groupBy("keyword", "ngram").agg(F.max(F.struct(*[c for c in lexicon.columns if c not in ("keyword", "ngram")])).alias("w")).select("keyword", "ngram", "w.*"), "lexicon")
    hits = _phrases(docs, own, min_ngram, stemmed)
    mp, ec = F.col("mp_acco") + F.col("mp_neut") + F.col("mp_rest"), F.col("ec_nega") + F.col("ec_neut") + F.col("ec_posi")
    times = lambda x: F.sum(F.col("times") * x)
    per = hits.groupBy("doc_id", *(["keyword"] if per_word else [])).agg(times(F.col("mp_rest") - F.col("mp_acco")).alias("mp"), times(F.col("ec_posi") - F.col("ec_nega")).alias("ec"), times(mp).alias("mp_all"), times(ec).alias("ec_all"))
    totals = per.groupBy("doc_id").agg(F.sum("mp_all").alias("mp_all"), F.sum("ec_all").alias("ec_all"))
    base = docs.select("doc_id", F.col(parent_col).alias("_parent")).join(totals, "doc_id", "left").na.fill(0.0, ["mp_all", "ec_all"])
    means = base.groupBy("_parent").agg(F.avg("mp_all").alias("mp_mean"), F.avg("ec_all").alias("ec_mean"))
    floor = math.sqrt(2.0**-52)
    wide = base.select("doc_id", "_parent").join(means, "_parent").join(per.select("doc_id", *(["keyword"] if per_word else []), "mp", "ec"), "doc_id", "inner" if per_word else "left")
    value = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) / F.greatest(F.col(f"{c}_mean"), F.lit(floor))).alias(c)
    return wide.select("doc_id", *(["keyword"] if per_word else []), value("mp"), value("ec"))


def partial(vocab_words: DataFrame, negative: int = 1) -> dict[str, list[str]]:
    """The lexicon of generated vocabularies: words of one sentiment are negative, those of the others positive."""
    names = sorted({r[0] for r in vocab_words.where(F.col("word").rlike("^sentiment[0-9]+w")).select(F.regexp_extract("word", "^(sentiment[0-9]+)w", 1)).distinct().collect()})
    return {"negative": [f"{n}w*" for n in names if n == f"sentiment{negative}"], "positive": [f"{n}w*" for n in names if n != f"sentiment{negative}"]}


def as_table(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(c, p) for c, some in lexicon.items() for p in some], "category string, pattern string")
