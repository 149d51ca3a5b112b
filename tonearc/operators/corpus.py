"""Tokens, vocabularies, bags of words and token windows.

Tokens are rows (doc_id, pos from 0, word); a null word is padding: a word that was removed and keeps its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearc.functions.shared import saved

LETTERS = r"\p{L}+"


def tokenise(docs: DataFrame, text_col: str = "text", pattern: str = LETTERS) -> DataFrame:
    """Lower-cased matches of the pattern, in order; a document without one has no rows."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(pattern), F.lit(0))
    return docs.select("doc_id", F.posexplode(found).alias("pos", "word"))


def token_lists(docs: DataFrame, text_col: str = "text", pattern: str = LETTERS) -> DataFrame:
    """(doc_id, words): what tokenise() finds, a document's in one array."""
    return docs.select("doc_id", F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(pattern), F.lit(0)).alias("words"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """word_id (from 0, in order of words), word, n, df: no unused types, no padding."""
    counted = tokens.where(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("df"))
    return with_rank(counted, "word_id", "word")


def with_rank(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with a gapless rank from 0, sorted in parallel: ranges are ranked on their own and shifted by what precedes."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    parts = saved(ranged, "ranges")  # read twice: ranges that are drawn again need not be the same
    local = parts.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    before = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_part", "_rank", "_before")


def bag_of_words(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("word").isNotNull()).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def bag_to_tokens(bag: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Every word n times, words in order; with docs, empty documents keep one row of null pos. Negative counts fail."""
    n = F.when(F.col("n") < 0, F.raise_error(F.lit("negative count"))).otherwise(F.col("n"))
    many = bag.where(n > 0).select("doc_id", "word", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    out = many.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("word", "k")) - 1).alias("pos"), "word")
    return out if docs is None else docs.select("doc_id").distinct().join(out, "doc_id", "left")


#: Words to keep up to which they are sent to every task (100 MB there); places in which more than that meet their tokens.
KEPT, PLACES = 1_000_000, 32


def keep_features(tokens: DataFrame, keep: DataFrame, ignore: list[str] | None = None, case_insensitive: bool = False, padding: bool = True) -> DataFrame:
    """Tokens whose word is in keep (word) or ignore; the others become padding, or go."""
    fold = F.lower if case_insensitive else (lambda c: c)
    kept = keep.select(fold(F.col("word")).alias("_key"))
    if ignore:
        kept = kept.unionByName(tokens.sparkSession.createDataFrame([(w,) for w in ignore], "_key string").select(fold(F.col("_key")).alias("_key")))
    kept = saved(kept.where("_key is not null").distinct(), "kept").withColumn("_in", F.lit(True))
    own, how = tokens.withColumn("_key", fold(F.col("word"))), "left" if padding else "inner"
    if kept.count() <= KEPT:
        joined = own.join(F.broadcast(kept), "_key", how)
    else:  # a frequent word's tokens meet it in as many places
        spread = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(PLACES)).cast("int")
        joined = own.withColumn("_place", spread).join(kept.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)))), ["_key", "_place"], how)
    if padding:
        return joined.select("doc_id", "pos", F.when(F.col("_in"), F.col("word")).alias("word"))
    return joined.where(F.col("_in")).select("doc_id", "pos", "word")


def trim(tokens: DataFrame, min_docs: int = 10, max_share: float = 1.0, min_letters: int = 3, min_tokens: int = 0, stop_words: list[str] | None = None, always: list[str] | None = None) -> DataFrame:
    """The usual preparation: short documents go; rare, ubiquitous, short and stop words become padding."""
    if min_tokens:
        tokens = tokens.join(tokens.groupBy("doc_id").count().where(F.col("count") > min_tokens).select("doc_id"), "doc_id", "left_semi")
    n_docs = tokens.select(F.countDistinct("doc_id").alias("d"))
    words = vocabulary(tokens).join(F.broadcast(n_docs)).where((F.col("df") >= min_docs) & (F.col("df") < F.col("d") * max_share + (1 if max_share >= 1 else 0)) & (F.length("word") >= min_letters))
    if stop_words:
        words = words.where(~F.col("word").isin(stop_words))
    return keep_features(tokens, words, ignore=always)


def collocations(tokens: DataFrame, min_count: int = 500) -> DataFrame:
    """Adjacent pairs that occur at least min_count times: (first, second, n)."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    return tokens.select(F.col("word").alias("first"), F.lead("word").over(order).alias("second")).where("first is not null and second is not null").groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def collocations_of(lists: DataFrame, min_count: int = 500) -> DataFrame:
    """collocations() of lists (doc_id, words) without padding: pairs are made where the documents lie."""
    next_words = F.slice("words", F.lit(2), F.size("words"))
    pairs = lists.where("words is not null").select(F.inline(F.arrays_zip(F.col("words").alias("first"), next_words.alias("second")))).toDF("first", "second").where("second is not null")
    return pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _lengths(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg((F.max("pos") + 1).alias("length"))


def window_count(tokens: DataFrame, window: int | None) -> DataFrame:
    """One row, n_windows: sliding windows of exactly `window` places, padding included; a shorter document is one."""
    w = F.lit(1) if window is None else F.greatest(F.lit(1), F.col("length") - window + 1)
    return _lengths(tokens).select(F.sum(w).alias("n_windows"))


def virtual_documents(tokens: DataFrame, window: int | None = 10) -> DataFrame:
    """(doc_id, start, words): every window as an array in order; None: whole documents. Padding takes a place but is
    not listed."""
    if window is None:
        return tokens.groupBy("doc_id").agg(F.lit(0).alias("start"), F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "word")))), lambda s: s.word).alias("words"))
    frame = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, window - 1)
    wide = tokens.withColumn("words", F.collect_list("word").over(frame)).withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return wide.where((F.col("pos") == 0) | (F.col("pos") <= F.col("length") - window)).select("doc_id", F.col("pos").alias("start"), "words")


def window_words(tokens: DataFrame, window: int | None, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, word), distinct: which words each window holds; words restricts them before windows are made."""
    own = tokens.where(F.col("word").isNotNull())
    if words is not None:
        own = own.join(words.select("word").distinct(), "word", "left_semi")
    if window is None:
        return own.select("doc_id", F.lit(0).alias("start"), "word").distinct()
    longest = own.join(_lengths(tokens), "doc_id")
    first, last = F.greatest(F.lit(0), F.col("pos") - window + 1), F.greatest(F.lit(0), F.least(F.col("pos"), F.col("length") - window))
    return longest.select("doc_id", F.explode(F.sequence(F.least(first, last), last)).alias("start"), "word").distinct()


def window_stretches(tokens: DataFrame, window: int | None, words: DataFrame | None = None) -> DataFrame:
    """(doc_id, word, stretches): the windows that hold a word, as stretches from a to z of starts that do not touch."""
    own = tokens.where(F.col("word").isNotNull())
    if words is not None:
        own = own.join(words.select("word").distinct(), "word", "left_semi")
    if window is None:
        return own.select("doc_id", "word").distinct().withColumn("stretches", F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("z"))))
    places = own.groupBy("doc_id", "word").agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("p")).join(_lengths(tokens), "doc_id")
    heads = F.filter("p", lambda x, i: (i == 0) | (x - F.element_at("p", F.greatest(i, F.lit(1))) > window))
    tails = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.element_at("p", F.least(i + 2, F.size("p"))) - x > window))
    last = F.greatest(F.lit(0), F.col("length") - window)
    cut = lambda s: F.struct(F.least(last, F.greatest(F.lit(0), s.h - window + 1)).cast("int").alias("a"), F.least(s.t, last).cast("int").alias("z"))
    return places.withColumn("h", heads).withColumn("t", tails).select("doc_id", "word", F.transform(F.arrays_zip("h", "t"), cut).alias("stretches"))
