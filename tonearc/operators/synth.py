"""Generated vocabularies and documents of known topics, to test estimation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_vocabulary(spark: SparkSession, topics: int = 5, sentiments: int = 3, words: int = 5, common: int = 2, concentration: float = 0.0, seed: int = 1) -> DataFrame:
    """(word, topic, sent, p), indices from 1: words of a topic and sentiment, words common to a topic, and words common
    to a sentiment; p is uniform in each pair, or Dirichlet of the concentration."""
    rows, rng = [], np.random.default_rng(seed)
    for t in range(1, topics + 1):
        for s in range(1, sentiments + 1):
            own = [f"topic{t}sent{s}w{i}" for i in range(1, words + 1)] + [f"topic{t}w{i}" for i in range(1, common + 1)] + ([f"sentiment{s}w{i}" for i in range(1, common + 1)] if sentiments > 1 else [])
            p = np.full(len(own), 1 / len(own)) if concentration == 0 else rng.dirichlet(np.full(len(own), concentration))
            rows += [(w, t, s, float(x)) for w, x in zip(own, p)]
    return spark.createDataFrame(rows, "word string, topic int, sent int, p double")


def vocabulary_from_lists(spark: SparkSession, lists: dict[tuple[int, int], list[str]]) -> DataFrame:
    """The same from words by (topic, sentiment), uniform."""
    rows = [(w, t, s, 1 / len(some)) for (t, s), some in lists.items() for w in some]
    return spark.createDataFrame(rows, "word string, topic int, sent int, p double")


def generate_documents(spark: SparkSession, vocab: DataFrame, n: int = 100, l1_prior: float = 1.0, l2_prior: float = 5.0, words: int = 400, classes: int = 1, seed: int = 1, reverse: bool = True) -> DataFrame:
    """Tokens (doc_id, pos, word, topic, sent, class) of n documents; lengths are normal with a deviation of a fifth. Each
    document has a seed of its own, so partitioning does not matter."""
    table = vocab.toPandas()
    T, S = int(table["topic"].max()), int(table["sent"].max())
    groups = {k: (g["word"].to_numpy(), g["p"].to_numpy()) for k, g in table.groupby(["topic", "sent"])}

    def make(batches):
        for pdf in batches:
            out = []
            for doc in pdf["id"]:
                rng = np.random.default_rng([seed, int(doc)])
                kind = int(doc) % classes
                mix = np.random.default_rng([seed, 10**6 + kind])
                a, b = (T, S) if reverse else (S, T)
                first = rng.dirichlet(np.full(a, l1_prior) * (mix.uniform(0.5, 1.5, a) if classes > 1 else 1))
                second = rng.dirichlet(np.full(b, l2_prior), size=a)
                size = max(1, int(np.ceil(rng.normal(words, words / 5))))
                one = rng.choice(a, size, p=first)
                two = np.array([rng.choice(b, p=second[i]) for i in one])
                t, s = (one, two) if reverse else (two, one)
                for pos, (x, y) in enumerate(zip(t + 1, s + 1)):
                    w, p = groups[(x, y)]
                    out.append((doc, pos, w[rng.choice(len(w), p=p / p.sum())], int(x), int(y), kind + 1))
            yield pd.DataFrame(out, columns=["doc_id", "pos", "word", "topic", "sent", "class"])

    return spark.range(n).mapInPandas(make, "doc_id long, pos int, word string, topic int, sent int, class int")


def true_phi(vocab: DataFrame, L2: int) -> DataFrame:
    """The generating distribution as (word, z, p), z = (topic - 1) * L2 + sent - 1."""
    return vocab.select("word", ((F.col("topic") - 1) * L2 + F.col("sent") - 1).cast("int").alias("z"), "p")
