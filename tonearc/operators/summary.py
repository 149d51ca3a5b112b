"""Long mixtures, top words, representative documents, sunburst rows, LDAvis tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearc.model import TopicModel
from tonearc.operators import posterior as P

METHODS = ("frequency", "probability", "term-score", "frex")


def _label(labels, column: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(column) + 1)


def melt(m: TopicModel, include_docs: bool = False) -> DataFrame:
    """Long mixtures. LDA: doc_id, topic, prob. Others: doc_id, topic, sentiment, sentopic, l1_prob, l2_prob, prob."""
    if m.it < 1:
        raise ValueError("the model has not been fitted")
    x = P.doc_mixtures(m)
    if m.kind == "lda":
        out = x.select("doc_id", _label(m.topic_labels, "l1").alias("topic"), F.col("l1_p").alias("prob"))
    else:
        a, b = _label(m.l1_labels, "l1"), _label(m.l2_labels, "l2")
        topic, sentiment = (b, a) if m.kind == "jst" else (a, b)
        out = x.select("doc_id", topic.alias("topic"), sentiment.alias("sentiment"), F.concat_ws("_", a, b).alias("sentopic"), F.col("l1_p").alias("l1_prob"), F.col("l2_p").alias("l2_prob"), F.col("p").alias("prob"))
    return out.join(m.docs, "doc_id") if include_docs else out


def ranked_words(m: TopicModel, method: str = "frequency", w: float = 0.5) -> DataFrame:
    """(word, z, value [, overall]) of every cell by one of METHODS."""
    if method not in METHODS:
        raise ValueError(method)
    if method == "frequency":
        n = P.word_counts(m).select("word", "z", F.col("n").cast("double").alias("value"))
        return n.withColumn("overall", F.sum("value").over(Window.partitionBy("word")))
    p = P.phi(m).select("word", "z", "p")
    if method == "probability":
        return p.withColumnRenamed("p", "value")
    by_word = Window.partitionBy("word")
    if method == "term-score":  # in logarithms: the product over leaves may underflow
        v = p.withColumn("v", F.col("p") + 2.220446049250313e-16)
        return v.select("word", "z", F.round(F.col("v") * (F.log("v") - F.avg(F.log("v")).over(by_word)), 12).alias("value"))
    if not 0 <= w <= 1:
        raise ValueError("w must be between 0 and 1")
    # Words with the same probabilities in all leaves share their values: most are rare, so kinds of words are few.
    wide = p.groupBy("word").agg(F.array(*[F.max(F.when(F.col("z") == z, F.col("p"))) for z in range(m.Z)]).alias("ps"))
    kinds = wide.groupBy("ps").agg(F.count(F.lit(1)).alias("_n"))
    whole = F.aggregate("ps", F.lit(0.0), lambda a, x: a + x)
    e = kinds.select("ps", "_n", whole.alias("_s"), F.posexplode("ps").alias("z", "p")).withColumn("excl", F.round(F.col("p") / F.col("_s"), 12)).withColumn("p", F.round("p", 12))  # sums in another order must not break ties
    e = _ecdf(_ecdf(e, "excl"), "p")
    value = 1 / (F.lit(float(w)) / F.col("excl_ecdf") + F.lit(1.0 - w) / F.col("p_ecdf"))
    values = e.groupBy("ps").agg(F.array_sort(F.collect_list(F.struct("z", value.alias("value")))).alias("v"))
    return wide.join(values, "ps").select("word", F.inline("v"))


def _ecdf(df: DataFrame, column: str) -> DataFrame:
    """Mean rank of the value in its leaf, over the leaf's size; a row stands for _n cells. Ranks are taken over distinct
    values with their counts: most cells of a leaf are ties (words it never drew), which then cost a row together."""
    tally = df.groupBy("z", column).agg(F.sum("_n").alias("_n"))
    order = Window.partitionBy("z").orderBy(column)
    ranks = tally.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("z")))
    ranks = ranks.select("z", column, ((F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_all")).alias(f"{column}_ecdf"))
    return df.join(ranks, ["z", column])


def top_words(m: TopicModel, n: int = 10, method: str = "frequency", subset: str | None = None, w: float = 0.5) -> DataFrame:
    """topic, sentiment (but for LDA), rank, word, value [, overall]: the n best of every leaf, ties by word. subset: a
    condition on the indices topic and sentiment (from 1), applied after the best are taken."""
    cells = ranked_words(m, method, w)
    best = _first_n(cells, n)
    topic, sentiment = m.topic("z"), m.sentiment("z")
    if subset:
        best = best.withColumn("_z", F.col("z")).withColumn("topic", topic + 1).withColumn("sentiment", sentiment + 1).where(subset).drop("topic", "sentiment")
    best = best.withColumn("t", topic).withColumn("s", sentiment)
    named = [_label(m.topic_labels, "t").alias("topic")] + ([] if m.kind == "lda" else [_label(m.sentiment_labels, "s").alias("sentiment")])
    return best.select(*named, "rank", "word", "value", *(["overall"] if "overall" in best.columns else []))


def _first_n(cells: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("z").orderBy(F.desc("value"), "word")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_word_index(m: TopicModel, n: int = 10, method: str = "probability") -> DataFrame:
    """(z, word) of the n best words."""
    return _first_n(ranked_words(m, method), n).select("z", "word")


def top_words_matrix(m: TopicModel, n: int = 10, method: str = "frequency") -> DataFrame:
    """rank and a column per leaf."""
    best = _first_n(ranked_words(m, method), n).withColumn("leaf", _label(m.leaf_labels(), "z"))
    return best.groupBy("rank").pivot("leaf", list(m.leaf_labels())).agg(F.first("word"))


def representative_docs(m: TopicModel, topic: int, sentiment: int | None = None, n: int = 3) -> DataFrame:
    """The n documents with most of a topic (and sentiment), from 0: doc_id, prob, text (words without padding)."""
    x = P.doc_mixtures(m)
    l1, l2 = (("l2", "l1") if m.kind == "jst" else ("l1", "l2")), None
    cond = F.col(l1[0]) == topic
    if sentiment is not None:
        cond &= F.col(l1[1]) == sentiment
    best = x.where(cond).groupBy("doc_id").agg(F.sum("p").alias("prob")).orderBy(F.desc("prob"), "doc_id").limit(n)
    own = m.tokens.where(F.col("word").isNotNull()).join(F.broadcast(best), "doc_id", "left_semi")
    text = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s.word), " ").alias("text"))
    return best.join(text, "doc_id", "left")


def sentiment_shares(m: TopicModel) -> DataFrame:
    """(doc_id, topic, date, share): what each topic holds of a document's stored sentiment."""
    x = melt(m, include_docs=True)
    return x.groupBy("doc_id", "topic", "date").agg((F.sum("prob") * F.first("sentiment")).alias("share"))


def top_words_plot(m: TopicModel, n: int = 10, method: str = "probability") -> DataFrame:
    """The n best words of every leaf for a chart with a facet each: facet, word, rank, value, item (a name that is the
    word's in this facet alone) and place (order of items, by facet and value, smallest first)."""
    best = _first_n(ranked_words(m, method), n).withColumn("facet", _label(m.leaf_labels(), "z"))
    order = Window.orderBy("z", "value", F.desc("word"))  # n rows a leaf
    return best.select("facet", "word", "rank", "value", F.concat_ws("___", "word", "facet").alias("item"), F.row_number().over(order).alias("place"))


def sunburst(m: TopicModel, n: int = 5, layers: int = 3, sort: bool = False, colors: bool = False) -> DataFrame:
    """(id, parent, label, level, value, real): mean share of l1, of l2 in it, and the top words of the leaf, rescaled to
    90 % of their parent; real: the share itself (of l1, of l2 given l1, or the word's probability). layers: the levels
    from the middle; sort adds place, by level and size; colors adds color, of the sentiment or else of the l1."""
    x = P.doc_mixtures(m).withColumn("a", _label(m.l1_labels, "l1")).withColumn("b", _label(m.l2_labels, "l2"))
    first = x.groupBy("a").agg((F.sum(F.when(F.col("l2") == 0, F.col("l1_p"))) / F.count_if(F.col("l2") == 0)).alias("value"))
    none = F.lit(None).cast("string")
    out = first.select(F.col("a").alias("id"), F.lit("").alias("parent"), F.col("a").alias("label"), F.lit(1).alias("level"), "value", F.col("value").alias("real"), F.col("a").alias("a"), none.alias("b"))
    leaves = x.groupBy("a", "b").agg(F.avg("p").alias("value"))
    if m.L2 > 1 and layers > 1:
        two = leaves.join(F.broadcast(first.withColumnRenamed("value", "whole")), "a")
        out = out.unionByName(two.select(F.concat_ws("/", "a", "b").alias("id"), F.col("a").alias("parent"), F.col("b").alias("label"), F.lit(2).alias("level"), "value", (F.col("value") / F.col("whole")).alias("real"), "a", "b"))
    if layers > (2 if m.L2 > 1 else 1):
        words = _first_n(P.phi(m).select("word", "z", F.col("p").alias("value")), n).withColumn("l1", m.l1("z")).withColumn("l2", m.l2("z")).withColumn("a", _label(m.l1_labels, "l1")).withColumn("b", _label(m.l2_labels, "l2"))
        words = words.join(F.broadcast(leaves.select("a", "b", F.col("value").alias("leaf"))), ["a", "b"])
        share = F.col("value") / F.sum("value").over(Window.partitionBy("a", "b"))
        parent = F.col("a") if m.L2 == 1 else F.concat_ws("/", "a", "b")
        out = out.unionByName(words.select(F.concat_ws("/", parent, "word").alias("id"), parent.alias("parent"), F.col("word").alias("label"), F.lit(3).alias("level"), (share * 0.9 * F.col("leaf")).alias("value"), F.col("value").alias("real"), "a", "b"))
    if sort:
        out = out.withColumn("place", F.row_number().over(Window.orderBy("level", F.desc("value"), "id")))  # a row per topic, leaf and top word
    if colors:
        of = lambda labels, kind, c: F.element_at(F.create_map(*[F.lit(v) for pair in zip(labels, palette(len(labels), kind)) for v in pair]), F.col(c))
        topic, level = ("b", "a") if m.kind == "jst" else ("a", "b")
        shade = of(m.topic_labels, "topic", topic) if m.kind == "lda" else F.coalesce(of(m.sentiment_labels, "sentiment", level), of(m.topic_labels, "topic", topic))
        out = out.withColumn("color", shade)
    return out.drop("a", "b")


def ldavis_tables(m: TopicModel) -> dict[str, DataFrame]:
    """The five tables that LDAvis takes: phi, theta, doc_length, vocab with term_frequency."""
    lengths = P.count_zd(m).groupBy("doc_id").agg(F.sum("n").alias("doc_length"))
    terms = P.count_zw(m).groupBy("word").agg(F.sum("n").alias("term_frequency"))
    return {"phi": P.phi(m).select("z", "word", "p"), "theta": P.doc_l1(m).select("doc_id", "l1", "p"), "doc_length": m.docs.select("doc_id").join(lengths, "doc_id", "left").na.fill(0), "vocab": m.vocab.select("word"), "term_frequency": terms}


def ldavis_json(m: TopicModel, cells: int = 5_000_000) -> str:
    """The five tables as the JSON that LDAvis reads: phi by topic, theta by document, doc.length, vocab, term.frequency,
    vocabulary and documents in order. That is one text on the driver: more than so many cells are an error."""
    tables, docs, words = ldavis_tables(m), m.docs.count(), m.vocab.count()
    if (docs + words) * m.Z > cells:
        raise ValueError(f"{(docs + words) * m.Z} cells are too many for one text")
    phi = tables["phi"].groupBy("word").agg(F.array_sort(F.collect_list(F.struct("z", "p"))).alias("p")).join(tables["term_frequency"], "word", "left").orderBy("word").collect()
    theta = tables["theta"].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l1", "p"))).alias("p")).join(tables["doc_length"], "doc_id").orderBy("doc_id").collect()
    by_word = [[c.p for c in r.p] for r in phi]
    return json.dumps({"phi": [list(x) for x in zip(*by_word)], "theta": [[c.p for c in r.p] for r in theta], "doc.length": [r.doc_length for r in theta], "vocab": [r.word for r in phi], "term.frequency": [r.term_frequency or 0 for r in phi]})


def palette(n: int, kind: str = "topic") -> list[str]:
    """n colours as hex strings: evenly spaced hues, or red to green for sentiments."""
    import colorsys

    hue = [i / n for i in range(n)] if kind == "topic" else [i / max(n - 1, 1) / 3 for i in range(n)]
    return ["#" + "".join(f"{round(255 * c):02x}" for c in colorsys.hls_to_rgb(h, 0.55, 0.6)) for h in hue]


def vega_lite(mark: str, x: str, y: str, color: str) -> str:
    """A Vega-Lite specification for one of the plot tables."""
    return json.dumps({"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "mark": mark, "encoding": {"x": {"field": x}, "y": {"field": y, "type": "quantitative"}, "color": {"field": color}}})
