"""Topics merged into themes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tonearc.model import TopicModel


def merge_topics(m: TopicModel, groups: dict[str, list[int]] | list[list[int]]) -> TopicModel:
    """groups of topics (from 1) that partition all of them, two groups or more; priors of merged topics add up."""
    if m.kind == "jst":
        raise ValueError("topics of a JST depend on the sentiment and cannot be merged")
    named = groups if isinstance(groups, dict) else {f"theme{i + 1}": g for i, g in enumerate(groups)}
    flat = [t for g in named.values() for t in g]
    again = sorted({t for t in flat if flat.count(t) > 1})
    missing = sorted(set(range(1, m.K + 1)) - set(flat))
    unknown = sorted(set(flat) - set(range(1, m.K + 1)))
    if again or missing or unknown or len(named) < 2:
        raise ValueError(f"no partition of the topics: repeated {again}, missing {missing}, unknown {unknown}, {len(named)} groups")
    to = {t - 1: i for i, g in enumerate(named.values()) for t in g}
    table = F.array(*[F.lit(to[t]) for t in range(m.K)])
    tokens = m.tokens.withColumn("z", (F.element_at(table, F.floor(F.col("z") / m.L2).cast("int") + 1) * m.L2 + F.col("z") % m.L2).cast("int"))
    join = lambda values: tuple(sum(values[t - 1] for t in g) for g in named.values())
    leaf = lambda values: tuple(sum(values[(t - 1) * m.L2 + s] for t in g) for g in named.values() for s in range(m.L2))
    docs = m.docs.drop("sentiment") if m.internal_sentiment and m.kind != "lda" else m.docs
    return replace(m, tokens=tokens, docs=docs, K=len(named), alpha=join(m.l1_prior), gamma=leaf(m.l2_prior) if m.kind == "rjst" else m.gamma, beta=leaf(m.beta_z), topics=tuple(named))
