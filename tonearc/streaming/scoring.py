"""Arriving documents scored by a fitted model. The reference has no streams; this goes beyond it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearc.model import TopicModel
from tonearc.operators import posterior as P
from tonearc.operators.gibbs import TABLE_CELLS


def fold_in(m: TopicModel, docs: DataFrame, rounds: int = 20) -> DataFrame:
    """(doc_id, date, mixture): documents (doc_id, date, words) under the fixed phi of an LDA; batch or stream. Words that
    the model does not know count for nothing. Every task holds phi: more than gibbs.TABLE_CELLS cells are an error."""
    if m.vocab.count() * m.Z > TABLE_CELLS:
        raise ValueError("the vocabulary is too large for a table on every task: trim it")
    table = P.phi(m).select("word", "z", "p").toPandas().pivot(index="word", columns="z", values="p")
    index, phi, prior = {w: i for i, w in enumerate(table.index)}, table.to_numpy(), np.array(m.l1_prior)
    shared = docs.sparkSession.sparkContext.broadcast((index, phi))

    def score(batches):
        index, phi = shared.value
        for pdf in batches:
            out = []
            for words in pdf["words"]:
                own = phi[[index[w] for w in words if w in index]]
                theta = prior / prior.sum()
                for _ in range(rounds if len(own) else 0):
                    r = own * theta
                    theta = prior + (r / r.sum(axis=1, keepdims=True)).sum(axis=0)
                    theta /= theta.sum()
                out.append(theta.tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "date": pdf["date"], "mixture": out})

    return docs.select("doc_id", "date", "words").mapInPandas(score, "doc_id long, date timestamp, mixture array<double>")


def daily_proportions(scored: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, topic, value) of a stream of fold_in rows: daily mean mixtures, closed by a watermark."""
    long = scored.withWatermark("date", late).select("date", F.posexplode("mixture").alias("topic", "p"))
    days = long.groupBy(F.window("date", "1 day").alias("w"), "topic").agg(F.avg("p").alias("value"))
    return days.select(F.col("w.start").cast("date").alias("day"), "topic", "value")
