"""Document and topic sentiment from the sentiment layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearc.model import TopicModel
from tonearc.operators import posterior as P

METHODS = ("proportional", "proportionalPol")


def _polarity(positive: Column, negative: Column, method: str) -> Column:
    return positive - negative if method == "proportional" else (positive - negative) / (positive + negative)


def _check(m: TopicModel, method: str) -> tuple[int, int]:
    if method not in METHODS:
        raise ValueError(method)
    if m.kind == "lda":
        raise ValueError("an LDA has no sentiment of its own: give documents one")
    if not {"negative", "positive"} <= set(m.sentiment_labels):
        raise ValueError("sentiment needs the levels negative and positive")
    return m.sentiment_labels.index("positive"), m.sentiment_labels.index("negative")


def topic_sentiment(m: TopicModel, method: str = "proportional", conditional: bool = False) -> DataFrame:
    """(doc_id, topic, s, theta) of an rJST. Proportional: p(positive, topic) - p(negative, topic), on joint
    probabilities, or, if conditional, on those given the topic."""
    positive, negative = _check(m, method)
    value = "l2_p" if conditional else "p"
    x = P.doc_mixtures(m).groupBy("doc_id", F.col("l1").alias("topic")).agg(F.max("l1_p").alias("theta"), F.max(F.when(F.col("l2") == positive, F.col(value))).alias("pos"), F.max(F.when(F.col("l2") == negative, F.col(value))).alias("neg"))
    return x.select("doc_id", "topic", _polarity(F.col("pos"), F.col("neg"), method).alias("s"), "theta")


def document_sentiment(m: TopicModel, method: str = "proportional", override: bool = False, conditional: bool = False, include_docs: bool = False) -> DataFrame:
    """(doc_id, sentiment): what the model stores, unless override; else from a JST's sentiment shares, or from an rJST's
    topics, weighted by their shares. include_docs: with the documents' other columns."""
    if include_docs:
        return document_sentiment(m, method, override, conditional).join(m.docs.drop("sentiment", "sentiment_scaled"), "doc_id")
    if "sentiment" in m.docs.columns and not override:
        return m.docs.select("doc_id", "sentiment")
    positive, negative = _check(m, method)
    if m.kind == "jst":
        x = P.doc_l1(m).groupBy("doc_id").agg(F.max(F.when(F.col("l1") == positive, F.col("p"))).alias("pos"), F.max(F.when(F.col("l1") == negative, F.col("p"))).alias("neg"))
        return x.select("doc_id", _polarity(F.col("pos"), F.col("neg"), method).alias("sentiment"))
    return topic_sentiment(m, method, conditional).groupBy("doc_id").agg(F.sum(F.col("s") * F.col("theta")).alias("sentiment"))
