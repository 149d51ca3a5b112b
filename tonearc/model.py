"""Topic-sentiment models as tables and a few numbers.

Two layers: L1 leads to L2. An LDA has topics in L1 and one L2; an rJST has topics in L1 and sentiments in L2; a JST the
other way round. Leaf z = l1 * L2 + l2, all from 0; labels are attached at the edge.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _spread(prior, n: int, l1: int, l2: int, name: str) -> tuple[float, ...]:
    if isinstance(prior, int | float):
        return (float(prior),) * n
    values = tuple(float(x) for x in prior)
    if len(values) == n:
        return values
    if n == l1 * l2 and len(values) == l2:
        return values * l1
    if n == l1 * l2 and len(values) == l1:
        return tuple(v for v in values for _ in range(l2))
    raise ValueError(f"{name}: {len(values)} values where {n} are needed")


@dataclass(frozen=True)
class TopicModel:
    """docs: doc_id and metadata (date, sentiment, ...); tokens: doc_id, pos, word, z; vocab: word, lex (or null)."""

    kind: str  # lda, rjst or jst
    docs: DataFrame
    tokens: DataFrame
    vocab: DataFrame
    K: int = 5
    S: int = 1
    alpha: object = 1.0
    gamma: object = 5.0
    beta: object = 0.01
    topics: tuple[str, ...] = ()
    sentiments: tuple[str, ...] = ()
    it: int = 0
    seed: int = 1
    internal_sentiment: bool = True
    loglik: tuple[tuple[float, float, float], ...] = field(default=(), repr=False)

    def __post_init__(self):
        if self.kind not in ("lda", "rjst", "jst"):
            raise ValueError(self.kind)
        if self.kind == "lda" and self.S != 1:
            raise ValueError("an LDA has no sentiment layer")
        if self.K * self.S == 1:
            raise ValueError("a model needs more than one leaf")
        self.l1_prior, self.l2_prior, self.beta_z  # noqa: B018  checks the shapes

    @property
    def L1(self) -> int:
        return self.S if self.kind == "jst" else self.K

    @property
    def L2(self) -> int:
        return {"lda": 1, "rjst": self.S, "jst": self.K}[self.kind]

    @property
    def Z(self) -> int:
        return self.L1 * self.L2

    @property
    def l1_prior(self) -> tuple[float, ...]:
        prior, name = (self.gamma, "gamma") if self.kind == "jst" else (self.alpha, "alpha")
        return _spread(prior, self.L1, self.L1, 1, name)

    @property
    def l2_prior(self) -> tuple[float, ...]:
        prior, name = (self.alpha, "alpha") if self.kind == "jst" else (self.gamma, "gamma")
        return _spread(1.0 if self.kind == "lda" else prior, self.Z, self.L1, self.L2, name)

    @property
    def beta_z(self) -> tuple[float, ...]:
        return _spread(self.beta, self.Z, self.L1, self.L2, "beta")

    @property
    def topic_labels(self) -> tuple[str, ...]:
        return self.topics or tuple(f"topic{i + 1}" for i in range(self.K))

    @property
    def sentiment_labels(self) -> tuple[str, ...]:
        default = {2: ("negative", "positive"), 3: ("negative", "neutral", "positive")}.get(self.S)
        return self.sentiments or default or tuple(f"sent{i + 1}" for i in range(self.S))

    @property
    def l1_labels(self) -> tuple[str, ...]:
        return self.sentiment_labels if self.kind == "jst" else self.topic_labels

    @property
    def l2_labels(self) -> tuple[str, ...]:
        return {"lda": ("",), "rjst": self.sentiment_labels, "jst": self.topic_labels}[self.kind]

    def leaf_labels(self) -> tuple[str, ...]:
        """Labels of all leaves, flat: topic, or l1_l2."""
        return self.topic_labels if self.kind == "lda" else tuple(f"{a}_{b}" for a in self.l1_labels for b in self.l2_labels)

    def labels(self, topic: list[str] | None = None, sentiment: list[str] | None = None) -> TopicModel:
        """The model under other labels; None resets them."""
        for own, n in ((topic, self.K), (sentiment, self.S)):
            if own is not None and len(own) != n:
                raise ValueError(f"{len(own)} labels for {n}")
        return replace(self, topics=tuple(topic or ()), sentiments=tuple(sentiment or ()))

    def l1(self, z: str = "z") -> Column:
        return F.floor(F.col(z) / self.L2).cast("int")

    def l2(self, z: str = "z") -> Column:
        return (F.col(z) % self.L2).cast("int")

    def topic(self, z: str = "z") -> Column:
        return self.l2(z) if self.kind == "jst" else self.l1(z)

    def sentiment(self, z: str = "z") -> Column:
        return self.l1(z) if self.kind == "jst" else self.l2(z)

    def allowed(self, z: str = "z", lex: str = "lex") -> Column:
        """Whether the lexicon lets a word into a leaf: its sentiment is the leaf's, or it has none."""
        if self.kind == "lda":
            return F.lit(True)
        names = F.array(*[F.lit(s) for s in self.sentiment_labels])
        return F.col(lex).isNull() | (F.array_position(names, F.col(lex)) == self.sentiment(z) + 1)

    # ---- metadata ----

    def with_dates(self, dates: DataFrame | None) -> TopicModel:
        """dates (doc_id, date); null dates fail; None removes them."""
        docs = self.docs.drop("date")
        if dates is None:
            return replace(self, docs=docs)
        if dates.where(F.col("date").isNull()).limit(1).count():
            raise ValueError("null dates")
        return replace(self, docs=docs.join(dates.select("doc_id", F.to_date("date").alias("date")), "doc_id", "left"))

    def dates(self) -> DataFrame:
        if "date" not in self.docs.columns:
            raise ValueError("the model has no dates")
        return self.docs.select("doc_id", F.to_date("date").alias("date"))

    def with_sentiment(self, sentiment: DataFrame | None) -> TopicModel:
        """sentiment (doc_id, sentiment) from outside; null values fail; None removes it, scaled values with it."""
        docs = self.docs.drop("sentiment", "sentiment_scaled")
        if sentiment is None:
            return replace(self, docs=docs, internal_sentiment=True)
        if sentiment.where(F.col("sentiment").isNull()).limit(1).count():
            raise ValueError("null sentiment")
        return replace(self, docs=docs.join(sentiment.select("doc_id", "sentiment"), "doc_id", "left"), internal_sentiment=False)

    def __str__(self) -> str:
        kinds = {"lda": f"LDA with {self.K} topics", "rjst": f"reversed-JST with {self.K} topics and {self.S} sentiments", "jst": f"JST with {self.S} sentiments and {self.K} topics"}
        return f"{kinds[self.kind]}, after {self.it} iterations"
