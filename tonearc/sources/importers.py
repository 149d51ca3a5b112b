"""Models and texts from elsewhere: tables of other estimators, MLlib, pipe-delimited speeches, HTML pages."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearc.model import TopicModel
from tonearc.operators import posterior as P


def from_assignments(tokens: DataFrame, K: int, alpha: float | tuple = 1.0, beta: float | tuple = 0.01, docs: DataFrame | None = None) -> TopicModel:
    """An LDA whose sampler kept assignments: tokens (doc_id, pos, word, z from 0)."""
    vocab = tokens.where(F.col("word").isNotNull()).select("word", F.lit(None).cast("string").alias("lex")).distinct()
    docs = tokens.select("doc_id").distinct() if docs is None else docs
    return TopicModel("lda", docs, tokens, vocab, K=K, alpha=alpha, beta=beta, it=1)


def from_lda_package(tokens: DataFrame, K: int, alpha: float | None = None, eta: float | None = None, docs: DataFrame | None = None) -> TopicModel:
    """The same under the defaults of collapsed samplers that report none: alpha 50 / K, eta 0.01."""
    return from_assignments(tokens, K, 50.0 / K if alpha is None else alpha, 0.01 if eta is None else eta, docs)


def from_mixtures(theta: DataFrame, bag: DataFrame, phi: DataFrame, K: int, alpha: float | tuple = 1.0, beta: float | tuple = 0.01, topics: tuple[str, ...] = ()) -> TopicModel:
    """An approximate LDA of an estimator that only gives theta (doc_id, z, p) and phi (word, z, p): each cell of the bag
    (doc_id, word, n) is shared out by p(z | doc, word), and rounded so that it sums to n. For variational, structural
    and seeded models alike; words without phi go."""
    lists = lambda df, k, p: df.groupBy(k).agg(*[F.max(F.when(F.col("z") == z, F.col("p"))).alias(f"{p}{z}") for z in range(K)])
    kinds = dict(bag.dtypes)

    def share(batches):
        for b in batches:
            q = np.stack([b.column(f"w{z}").to_numpy(zero_copy_only=False).astype(float) * b.column(f"d{z}").to_numpy(zero_copy_only=False).astype(float) for z in range(K)], axis=1)
            n, known = b.column("n").to_numpy(zero_copy_only=False).astype(np.int64), ~np.isnan(q)
            total = np.nansum(q, axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                x = n[:, None] * np.where(total > 0, q / total, 1 / known.sum(axis=1, keepdims=True))
            k = np.where(known, np.floor(x), 0).astype(np.int64)
            order = np.argsort(np.where(known, k - x, np.inf), axis=1, kind="stable")  # largest remainders first, ties by leaf
            first = np.arange(K)[None, :] < (n - k.sum(axis=1))[:, None]
            np.put_along_axis(k, order, np.take_along_axis(k, order, axis=1) + first, axis=1)
            k[~known.any(axis=1)] = 0
            at, z = np.nonzero(k > 0)
            took = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(took), b.column("word").take(took), pa.array(z.astype(np.int32)), pa.array(k[at, z])], ["doc_id", "word", "z", "k"])

    # A row for each word of a document goes to its word's numbers, then to its document's; leaves are columns, not rows.
    cells = bag.join(lists(phi, "word", "w"), "word").join(lists(theta, "doc_id", "d"), "doc_id").where(F.col("n") > 0)
    full = cells.mapInArrow(share, f"doc_id {kinds['doc_id']}, word {kinds['word']}, z int, k long")
    before = F.coalesce(F.sum("k").over(Window.partitionBy("doc_id").orderBy("word", "z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = full.withColumn("_before", before).select("doc_id", F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("k") - 1)).alias("pos"), "word", "z")
    tokens = each.select("doc_id", F.col("pos").cast("int").alias("pos"), "word", "z")
    return replace(from_assignments(tokens, K, alpha, beta, theta.select("doc_id").distinct()), topics=topics)


def from_mllib(fitted, data: DataFrame, words: list[str], bag: DataFrame) -> TopicModel:
    """An LDA of pyspark.ml: fitted model, its data (doc_id, features), vocabulary and bag (doc_id, word, n)."""
    from pyspark.ml.functions import vector_to_array

    spark, K = data.sparkSession, fitted.getK()
    weights = fitted.describeTopics(len(words)).select(F.col("topic").alias("z"), F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t")).select("z", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("p"))
    phi = weights.join(spark.createDataFrame(list(enumerate(words)), "i int, word string"), "i").select("word", "z", "p")
    theta = fitted.transform(data).select("doc_id", F.posexplode(vector_to_array("topicDistribution")).alias("z", "p"))
    prior = tuple(float(a) for a in fitted.estimatedDocConcentration())
    return from_mixtures(theta, bag, phi, K, prior if len(prior) == K else 1.0)


def approximate_counts(theta: DataFrame, phi: DataFrame, lengths: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Integer counts (doc_id, z, n) and (word, z, n) that stand for theta (doc_id, z, p) and phi (word, z, p) of an
    estimator that keeps none (structural, variational or seeded models): documents add up to lengths (doc_id, length),
    words to words (word, n), and both tables to the same total of each topic. Words without phi are an error, words of
    phi that the corpus does not have go."""
    share = theta.join(lengths, "doc_id").select("doc_id", "z", (F.col("p") * F.col("length")).alias("n"))
    by_topic = {r.z: r.n for r in share.groupBy("z").agg(F.sum("n").alias("n")).collect()}  # a row per topic
    total = int(lengths.agg(F.sum("length")).first()[0] or 0)
    if total != int(words.agg(F.sum("n")).first()[0] or 0):
        raise ValueError("documents and words do not add up to the same number of tokens")
    if words.join(phi.select("word"), "word", "left_anti").limit(1).count():
        raise ValueError("words that the model does not have")
    order = sorted(by_topic)
    wanted = dict(zip(order, (int(x) for x in P.largest_remainder(np.array([by_topic[z] for z in order]), total))))
    zd = P.repair_margins(share, "doc_id", "z", lengths.select("doc_id", F.col("length").alias("total")), wanted)
    sizes = F.element_at(F.create_map(*[F.lit(x) for z in order for x in (z, float(wanted[z]))]), F.col("z"))
    cells = phi.join(words.select("word"), "word", "left_semi").select("word", "z", (F.col("p") * sizes).alias("n"))
    zw = P.repair_margins(cells, "word", "z", words.select("word", F.col("n").alias("total")), wanted)
    return zd, zw


def counts_as_model(theta: DataFrame, lengths: DataFrame, prior: tuple) -> DataFrame:
    """Integer counts (doc_id, l1, n) that theta (doc_id, l1, p) and lengths (doc_id, length) stand for."""
    return P.repair(P.l1_counts(theta, lengths, prior), "doc_id", "l1", lengths.withColumnRenamed("length", "total"))


def speeches(spark: SparkSession, path: str, lang: str | None = "en") -> DataFrame:
    """Pipe-delimited speeches (date|speakers|title|subtitle|contents), unquoted; footnote marks and headers removed; only
    texts of one language if a column lang says so."""
    raw = spark.read.csv(path, sep="|", header=True, quote="", mode="PERMISSIVE")
    if lang is not None and "lang" in raw.columns:
        raw = raw.where(F.col("lang") == lang)
    text = F.regexp_replace("contents", r"\[\s*[0-9]+\s*\]", " ")
    text = F.regexp_replace(text, r"(?i)see also footnotes?[^.]*\.", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return raw.withColumn("text", text).withColumn("date", F.to_date("date")).where(F.length("text") > 0).drop("contents")


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def url_date(url: Column) -> Column:
    """The first date (year, month and day in digits, with or without marks between them) in a URL, or null."""
    found = F.regexp_extract(url, r"((?:19|20)[0-9]{2})[-/_]?(0[1-9]|1[0-2])[-/_]?(0[1-9]|[12][0-9]|3[01])", 0)
    return F.try_to_date(F.regexp_replace(found, r"[-/_]", ""), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.regexp_replace(found, r"[-/_]", ""), F.lit("yyyyMMdd")))


def html_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", stop: str | None = None, main: str | None = None) -> DataFrame:
    """(page_id, paragraph, paragraph_id, kind, text): headings and paragraphs of a page in order, tags stripped, entities
    decoded, empty ones left out; stop: a regular expression at whose first match a page ends (questions and answers); main: one whose first
    group is the part of a page that counts (a page without it counts whole)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    if main is not None:
        html = F.when(F.regexp_like(html, F.lit(main)), F.regexp_extract(html, main, 1)).otherwise(html)
    if stop is not None:
        html = F.element_at(F.split(html, stop, 2), 1)
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<(?:h1|h2|p)(?:\s[^>]*)?>.*?</(?:h1|h2|p)>"), F.lit(0))
    text = F.regexp_replace(F.col("block"), r"<[^>]*>", " ")
    for name, letter in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(letter))
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(blocks).alias("paragraph", "block"))
    out = rows.withColumn("kind", F.lower(F.regexp_extract("block", r"^<(\w+)", 1))).withColumn("text", F.trim(F.regexp_replace(text, r"\s+", " ")))
    return out.where(F.length("text") > 0).select("page_id", "paragraph", F.concat_ws("_", "page_id", F.col("paragraph") + 1).alias("paragraph_id"), "kind", "text")
