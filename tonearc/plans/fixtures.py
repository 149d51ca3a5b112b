"""Models on the driver's tables that need no sampling: assignments are a fixed function of document and place, so any
engine can recompute them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearc.model import TopicModel
from tonearc.operators import corpus, lexicon

LEXICON = {"negative": ["er*", "*ung"], "positive": ["*ing", "th*"], "valence_negator": ["to", "no", "de", "la"], "valence_amplifier": ["in", "die", "que", "of"]}
MIN_DOCS = 30


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int"))
    return documents(spark, sf_dir).select("doc_id", date.alias("date"), (((F.col("doc_id") * 31) % 200 - 100) / 100.0).alias("sentiment"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tokenise(documents(spark, sf_dir))


def lda(spark: SparkSession, sf_dir: str, trimmed: bool = False, factors: tuple[int, int] = (7919, 104729), alpha: float | tuple = 1.0) -> TopicModel:
    words = tokens(spark, sf_dir)
    if trimmed:
        words = corpus.trim(words, min_docs=MIN_DOCS, min_letters=1)
    z = ((F.col("doc_id") * factors[0] + F.col("pos").cast("long") * factors[1]) % 5).cast("int")
    own = words.select("doc_id", "pos", "word", F.when(F.col("word").isNotNull(), z).alias("z"))
    vocab = words.where(F.col("word").isNotNull()).select("word").distinct().withColumn("lex", F.lit(None).cast("string"))
    return TopicModel("lda", docs(spark, sf_dir), own, vocab, K=5, alpha=alpha, beta=0.01, it=1)


def two_layer(spark: SparkSession, sf_dir: str, kind: str) -> TopicModel:
    """An rJST of 5 topics and 3 sentiments, or a JST; words of the lexicon stand in leaves of their sentiment."""
    words = tokens(spark, sf_dir)
    vocab = lexicon.match(words.select("word").distinct(), LEXICON, ["negative", "positive"])
    any_leaf = ((F.col("doc_id") * 7919 + F.col("pos").cast("long") * 104729) % 15).cast("int")
    level = F.when(F.col("lex") == "negative", 0).when(F.col("lex") == "positive", 2)
    own = F.floor(any_leaf / 3).cast("int") * 3 + level if kind == "rjst" else level * 5 + any_leaf % 5
    z = F.coalesce(own, any_leaf).cast("int")
    leaf = lexicon.match(words, LEXICON, ["negative", "positive"]).select("doc_id", "pos", "word", z.alias("z"))  # tokens by themselves: a join would shuffle them all
    prior = {"alpha": 1.0, "gamma": 5.0} if kind == "rjst" else {"alpha": 5.0, "gamma": 1.0}
    return TopicModel(kind, docs(spark, sf_dir).drop("sentiment"), leaf, vocab, K=5, S=3, beta=0.01, it=1, **prior)


def rjst(spark: SparkSession, sf_dir: str) -> TopicModel:
    return two_layer(spark, sf_dir, "rjst")


def jst(spark: SparkSession, sf_dir: str) -> TopicModel:
    return two_layer(spark, sf_dir, "jst")


def rjst_external(spark: SparkSession, sf_dir: str) -> TopicModel:
    return replace(rjst(spark, sf_dir), docs=docs(spark, sf_dir), internal_sentiment=False)
