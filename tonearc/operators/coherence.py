"""Co-occurrence of words in windows, NPMI, and the coherence of top words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearc.model import TopicModel
from tonearc.operators import corpus
from tonearc.operators.summary import top_word_index

DEFAULT_WINDOW = {"C_NPMI": 10, "C_V": 110}


def cooccurrence(tokens: DataFrame, window: int | None, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(w1, w2, p1, p2, p12): shares of windows that hold the words and both, for w1 of left and w2 of right (left if
    None). Pairs that never meet are absent; a word meets itself wherever it stands.

    The windows of a document that hold a word are a few stretches of starts, so no window is ever a row: pairs of words
    of a document meet in as many windows as their stretches share."""
    if isinstance(window, str) and window != "boolean":
        raise ValueError(window)
    window = None if window == "boolean" else window
    one = corpus.window_stretches(tokens, window, left)
    two = one if right is None else corpus.window_stretches(tokens, window, right)
    total = corpus.window_count(tokens, window)
    size = lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x.z - x.a + 1)
    single = lambda df, w, p: df.groupBy(F.col("word").alias(w)).agg(F.sum(size("stretches")).alias(p))
    meet = lambda x, y: F.greatest(F.lit(0), F.least(x.z, y.z) - F.greatest(x.a, y.a) + 1)
    shared = F.aggregate("s1", F.lit(0), lambda a, x: a + F.aggregate("s2", F.lit(0), lambda b, y: b + meet(x, y)))
    pairs = one.select("doc_id", F.col("word").alias("w1"), F.col("stretches").alias("s1")).join(two.select("doc_id", F.col("word").alias("w2"), F.col("stretches").alias("s2")), "doc_id")
    both = pairs.withColumn("n", shared).where("n > 0").groupBy("w1", "w2").agg(F.sum("n").alias("n12"))
    out = both.join(single(one, "w1", "n1"), "w1").join(single(two, "w2", "n2"), "w2").join(F.broadcast(total))  # total: one row
    share = lambda c: (F.col(c) / F.col("n_windows"))
    return out.select("w1", "w2", share("n1").alias("p1"), share("n2").alias("p2"), share("n12").alias("p12"))


def npmi(pairs: DataFrame) -> DataFrame:
    """pairs with npmi: ln(p12 / (p1 p2)) / -ln p12; 1 where p12 is 1."""
    value = F.when(F.col("p12") >= 1, 1.0).otherwise(F.log(F.col("p12") / (F.col("p1") * F.col("p2"))) / -F.log("p12"))
    return pairs.withColumn("npmi", value)


def coherence(m: TopicModel, n: int = 10, method: str = "C_NPMI", window: int | str | None = "default", npmis: DataFrame | None = None) -> DataFrame:
    """(z, l1, l2, value). C_NPMI: mean NPMI over pairs of top words. C_V: mean cosine of each top word's NPMI vector with
    the sum of all, over the whole vocabulary; absent pairs count as -1 in both. npmis: a table to use again."""
    if n < 2:
        raise ValueError("coherence needs two words or more")
    if method not in DEFAULT_WINDOW:
        raise ValueError(method)
    window = DEFAULT_WINDOW[method] if window == "default" else window
    top = top_word_index(m, n)
    if method == "C_NPMI":
        pairs = top.withColumnRenamed("word", "w1").join(top.withColumnRenamed("word", "w2"), "z").where("w1 < w2")  # n (n - 1) / 2 a leaf
        values = npmis if npmis is not None else npmi(cooccurrence(m.tokens, window, top.select("word").distinct()))
        joined = pairs.join(values.select("w1", "w2", "npmi"), ["w1", "w2"], "left")
        out = joined.groupBy("z").agg(F.avg(F.coalesce("npmi", F.lit(-1.0))).alias("value"))
    else:
        values = npmis if npmis is not None else npmi(cooccurrence(m.tokens, window, top.select("word").distinct(), m.vocab.select("word")))
        # a = npmi + 1 is sparse (absent pairs are 0), and all sums over the vocabulary follow from its own.
        a = top.withColumnRenamed("word", "w1").join(values.select("w1", "w2", (F.col("npmi") + 1).alias("a")), "w1")
        b = a.groupBy("z", "w2").agg(F.sum("a").alias("b"))
        per_z = b.groupBy("z").agg(F.sum("b").alias("sb"), F.sum(F.col("b") * F.col("b")).alias("sbb"))
        per_w = a.join(b, ["z", "w2"]).groupBy("z", "w1").agg(F.sum("a").alias("sa"), F.sum(F.col("a") * F.col("a")).alias("saa"), F.sum(F.col("a") * F.col("b")).alias("sab"))
        size = m.vocab.agg(F.count(F.lit(1)).cast("double").alias("v"))
        count = top.groupBy("z").agg(F.count(F.lit(1)).cast("double").alias("k"))
        x = top.withColumnRenamed("word", "w1").join(per_w, ["z", "w1"], "left").join(per_z, "z").join(count, "z").join(F.broadcast(size)).na.fill(0.0)
        dot = F.col("sab") - F.col("k") * F.col("sa") - F.col("sb") + F.col("k") * F.col("v")
        aa, bb = F.col("saa") - 2 * F.col("sa") + F.col("v"), F.col("sbb") - 2 * F.col("k") * F.col("sb") + F.col("k") * F.col("k") * F.col("v")
        out = x.groupBy("z").agg(F.avg(dot / F.sqrt(aa * bb)).alias("value"))
    return out.select("z", m.l1().alias("l1"), m.l2().alias("l2"), "value")
