"""Estimation by blocked Gibbs sampling.

Given the mixtures and word distributions of a sweep, assignments of all cells (document, word) are independent: each is
one multinomial draw. So a sweep is one pass over the documents, and all that is shuffled is the table of counts of leaf
and word. Draws depend on (seed, chain, sweep, document) only: any number of executors gives the same chain.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearc.functions.shared import saved
from tonearc.functions.special import digamma, log_gamma
from tonearc.model import TopicModel

#: Cells of the leaf-word table up to which a sweep is run with the table on every task.
TABLE_CELLS = 50_000_000


def start(m: TopicModel) -> TopicModel:
    """Every token in a leaf at random; words of the lexicon in leaves of their sentiment. Only seed, document and place
    decide."""
    u = F.pmod(F.xxhash64(F.lit(m.seed), F.col("doc_id"), F.col("pos")), F.lit(1 << 40)) / float(1 << 40)
    tokens = m.tokens.drop("z").join(m.vocab.select("word", "lex"), "word", "left")
    any_leaf = F.floor(u * m.Z).cast("int")
    if m.kind == "lda":
        z = any_leaf
    else:
        level = F.array_position(F.array(*[F.lit(s) for s in m.sentiment_labels]), F.col("lex")).cast("int") - 1
        free = F.floor(u * m.K).cast("int")
        own = level * m.L2 + free if m.kind == "jst" else free * m.L2 + level
        z = F.when(F.col("lex").isNull(), any_leaf).otherwise(own)
    return replace(m, tokens=tokens.select("doc_id", "pos", "word", F.when(F.col("word").isNotNull(), z).alias("z")), it=0, loglik=())


def _pack(m: TopicModel) -> tuple[DataFrame, list[str], np.ndarray]:
    """Documents as arrays (doc_id, key: a number for it, and w, z, n: counts by word and leaf), the vocabulary, and beta
    by leaf and word."""
    vocab = m.vocab.select("word", "lex").orderBy("word").toPandas()
    if len(vocab) * m.Z > TABLE_CELLS:
        raise ValueError(f"{len(vocab)} words and {m.Z} leaves exceed the table of {TABLE_CELLS} cells: trim the vocabulary")
    level = vocab["lex"].map({s: i for i, s in enumerate(m.sentiment_labels)})
    z = np.arange(m.Z)
    leaf_level = z // m.L2 if m.kind == "jst" else z % m.L2
    beta = _beta(m, level.to_numpy(), leaf_level)
    ids = m.docs.sparkSession.createDataFrame(pd.DataFrame({"word": vocab["word"], "w": np.arange(len(vocab), dtype=np.int32)}))
    cells = m.tokens.where(F.col("word").isNotNull()).join(ids, "word").groupBy("doc_id", "w", "z").agg(F.count(F.lit(1)).cast("int").alias("n"))
    docs = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("w", "z", "n"))).alias("c"))
    part = lambda k: F.transform("c", lambda x: x[k]).alias(k)
    flat = docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("key"), part("w"), part("z"), part("n"))
    return saved(flat, "gibbs-documents"), vocab["word"].tolist(), beta


def _beta(m: TopicModel, level: np.ndarray, leaf_level: np.ndarray) -> np.ndarray:
    """Beta by leaf and word; 0 where the lexicon keeps a word (of a level, or nan) out."""
    beta = np.repeat(np.array(m.beta_z)[:, None], len(level), axis=1)
    if m.kind != "lda":
        known = ~pd.isna(level)
        beta[(leaf_level[:, None] != np.where(known, level, -1)[None, :]) & known[None, :]] = 0
    return beta


def _draw(rng: np.random.Generator, w: np.ndarray, n: np.ndarray, nz: np.ndarray, phi: np.ndarray, m: dict) -> np.ndarray:
    """New counts (words, leaves) of one document, given its leaf counts and phi."""
    L1, L2 = m["L1"], m["L2"]
    n1 = nz.reshape(L1, L2).sum(axis=1)
    theta = rng.gamma(n1 + m["l1"]) + 1e-300
    weight = np.repeat(theta / theta.sum(), L2)
    if L2 > 1:
        pi = (rng.gamma(nz + m["l2"]) + 1e-300).reshape(L1, L2)
        weight = weight * (pi / pi.sum(axis=1, keepdims=True)).ravel()
    p = phi[:, w].T * weight
    return rng.multinomial(n, p / p.sum(axis=1, keepdims=True))


#: How often each count occurs: (distinct counts, frequencies).
Histogram = tuple[np.ndarray, np.ndarray]


def histogram(counts: np.ndarray) -> Histogram:
    return np.unique(np.asarray(counts, float), return_counts=True)


def dirichlet_fixed_point(parts: list[Histogram], totals: Histogram, alpha: np.ndarray, tol: float = 1e-6, most: int = 100_000) -> np.ndarray:
    """Minka's fixed point of a Dirichlet-multinomial, from the histogram of each component's counts and of their sums."""
    alpha = np.asarray(alpha, float)
    for _ in range(most):
        s = np.array([alpha.sum()])
        below = (totals[1] * (digamma(totals[0] + s) - digamma(s))).sum()
        above = np.array([(f * (digamma(n + a) - digamma(np.array([a])))).sum() for (n, f), a in zip(parts, alpha)])
        new = np.maximum(alpha * above / max(below, 1e-300), 1e-10)
        if np.abs(new - alpha).max() < tol:
            return new
        alpha = new
    return alpha


def _log_w(n: np.ndarray, beta: np.ndarray, eps: float = 1e-9) -> float:
    s = beta.sum(axis=1)
    return float((log_gamma(s) - log_gamma(n.sum(axis=1) + s)).sum() + (log_gamma(n + beta + eps) - log_gamma(beta + eps)).sum())


def _log_layer(parts: list[Histogram], totals: Histogram, prior: np.ndarray) -> float:
    """Of documents whose component counts and sums have these histograms, under one prior."""
    s = np.array([prior.sum()])
    out = (totals[1] * (log_gamma(s) - log_gamma(totals[0] + s))).sum()
    return float(out + sum((f * (log_gamma(n + a) - log_gamma(np.array([a])))).sum() for (n, f), a in zip(parts, prior)))


def fit(m: TopicModel, iterations: int = 100, chain: int = 1, likelihood: bool = True, every: int = 10, alpha_cycle: int = 0, gamma_cycle: int = 0) -> TopicModel:
    """m after more sweeps. 0 sweeps change nothing. Every `every` sweeps the documents are written to the shared folder,
    so lineage stays short. alpha_cycle and gamma_cycle: sweeps between updates of the first and second layer's prior.

    The result's tokens carry assignments that agree with the sampled counts of (document, word, leaf); which of a
    document's equal words gets which leaf is free and goes by place."""
    if iterations == 0:
        return m
    spark = m.docs.sparkSession
    docs, _, beta = _pack(m)
    l1, l2, V = np.array(m.l1_prior), np.array(m.l2_prior), beta.shape[1]
    logs = list(m.loglik)
    seed, Z = m.seed, m.Z

    def table(df: DataFrame) -> np.ndarray:
        rows = df.select(F.explode(F.arrays_zip("w", "z", "n")).alias("c")).groupBy("c.w", "c.z").agg(F.sum("c.n").alias("n")).toPandas()
        out = np.zeros((m.Z, V))
        out[rows["z"].to_numpy(int), rows["w"].to_numpy(int)] = rows["n"]
        return out

    def histograms(df: DataFrame) -> dict[str, list[Histogram]]:
        """Histograms over documents of the counts of each leaf, each l1 and of all: a row per distinct count of each, so
        what is collected grows with the longest document, not with their number."""

        def of(z: int):
            return F.aggregate(F.arrays_zip("z", "n"), F.lit(0), lambda a, c: a + F.when(c.z == z, c.n).otherwise(0))

        n = [F.col(f"z{z}") for z in range(m.Z)]
        first = [sum(n[i * m.L2 + 1 : (i + 1) * m.L2], n[i * m.L2]) for i in range(m.L1)]
        cells = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("i"), x.cast("long").alias("n")) for k, some in (("z", n), ("l1", first), ("all", [sum(n[1:], n[0])])) for i, x in enumerate(some)]
        rows = df.select(*[of(z).alias(f"z{z}") for z in range(m.Z)]).select(F.explode(F.array(*cells)).alias("x")).groupBy("x.kind", "x.i", "x.n").count().toPandas()
        out = {}
        for kind, size in (("z", m.Z), ("l1", m.L1), ("all", 1)):
            own = [rows[(rows["kind"] == kind) & (rows["i"] == i)] for i in range(size)]
            out[kind] = [(x["n"].to_numpy(float), x["count"].to_numpy(float)) for x in own]
        return out

    counts, cached = table(docs), []
    for sweep in range(m.it + 1, m.it + iterations + 1):
        rng = np.random.default_rng([m.seed, chain, sweep])
        g = np.where(beta > 0, rng.gamma(counts + np.where(beta > 0, beta, 1)) + 1e-300, 0)
        shared = spark.sparkContext.broadcast((g / g.sum(axis=1, keepdims=True), {"L1": m.L1, "L2": m.L2, "l1": l1, "l2": l2}))

        def sample(batches, sweep=sweep, shared=shared):
            phi, params = shared.value
            for b in batches:
                first = b.column("w").offsets.to_numpy() - b.column("w").offsets[0].as_py()
                w, z, n = (b.column(k).flatten().to_numpy() for k in ("w", "z", "n"))
                keys, out = b.column("key").to_numpy(), [[np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]]
                sizes = np.zeros(b.num_rows + 1, np.int32)
                for k, (i, j) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    own, at = np.unique(w[i:j], return_inverse=True)
                    nz = np.bincount(z[i:j], weights=n[i:j], minlength=Z)
                    key = int(keys[k]) & 0xFFFFFFFFFFFFFFFF
                    rng = np.random.default_rng([seed, chain, sweep, key & 0xFFFFFFFF, key >> 32])
                    new = _draw(rng, own, np.bincount(at, weights=n[i:j]).astype(int), nz, phi, params)
                    x, y = np.nonzero(new)
                    for o, v in zip(out, (own[x], y, new[x, y])):
                        o.append(v.astype(np.int32))
                    sizes[k + 1] = len(x)
                at = pa.array(np.cumsum(sizes, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *(pa.ListArray.from_arrays(at, pa.array(np.concatenate(o)).cast(b.column(c).type.value_type)) for c, o in zip(("w", "z", "n"), out))], ["doc_id", "key", "w", "z", "n"])

        docs = docs.mapInArrow(sample, docs.schema)
        if sweep % every == 0 or sweep == m.it + iterations:
            docs = saved(docs, "gibbs-documents")
            for old in cached:
                old.unpersist()
            cached.clear()
        else:
            cached.append(docs := docs.cache())
        counts = table(docs)
        update = [c and sweep % c == 0 for c in (alpha_cycle, gamma_cycle)]
        if likelihood or any(update):
            h = histograms(docs)
            blocks = [slice(i * m.L2, (i + 1) * m.L2) for i in range(m.L1)]
            if update[0]:
                l1 = dirichlet_fixed_point(h["l1"], h["all"][0], l1)
            if update[1] and m.L2 > 1:
                l2 = np.concatenate([dirichlet_fixed_point(h["z"][b], h["l1"][i], l2[b]) for i, b in enumerate(blocks)])
            if likelihood:
                second = 0.0 if m.L2 == 1 else sum(_log_layer(h["z"][b], h["l1"][i], l2[b]) for i, b in enumerate(blocks))
                logs.append((_log_w(counts, beta), _log_layer(h["l1"], h["all"][0], l1), second))
    words = m.vocab.select("word").orderBy("word").toPandas().assign(w=lambda d: np.arange(len(d), dtype=np.int32))
    names = spark.createDataFrame(words)
    ranked = docs.select("doc_id", F.explode(F.arrays_zip("w", "z", "n")).alias("c")).select("doc_id", "c.*").join(names, "w")
    leaf = ranked.groupBy("doc_id", "word").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("z", "n"))), lambda s: F.array_repeat(s.z, s.n))).alias("zs"))
    place = m.tokens.drop("z").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "word").orderBy("pos")))
    tokens = place.join(leaf, ["doc_id", "word"], "left").select("doc_id", "pos", "word", F.when(F.col("word").isNotNull(), F.element_at("zs", F.col("k"))).alias("z"))
    priors = {"gamma": tuple(l1), "alpha": tuple(l2)} if m.kind == "jst" else {"alpha": tuple(l1), "gamma": tuple(l2) if m.L2 > 1 else m.gamma}
    return replace(m, tokens=saved(tokens, "gibbs-tokens"), it=m.it + iterations, loglik=tuple(logs), **priors)


def fit_chains(m: TopicModel, n_chains: int, iterations: int = 100, **more) -> list[TopicModel]:
    """Chain 1 goes on from m; the others start anew, unless m has been fitted. Sweeps of one chain run on the whole
    cluster, so chains follow each other; collapsed.fit_chains() runs small ones side by side."""
    out = []
    for c in range(1, n_chains + 1):
        own = replace(m, seed=m.seed + 7919 * (c - 1))
        out.append(fit(m if c == 1 else (start(own) if m.it == 0 else own), iterations, chain=c, **more))
    return out


def continue_chains(chains: list[TopicModel], iterations: int = 100, **more) -> list[TopicModel]:
    """More sweeps of each chain."""
    return [fit(c, iterations, chain=i, **more) for i, c in enumerate(chains, 1)]


def grow(m: TopicModel, iterations: int = 100, **more) -> TopicModel:
    """fit() by another name."""
    return fit(m, iterations, **more)


def recompile(m: TopicModel, lexicon: dict[str, list[str]] | DataFrame) -> TopicModel:
    """m under another lexicon (patterns, or a table of word and lex): words are matched anew, and every token starts in a
    leaf that its word may be in."""
    from tonearc.operators.lexicon import match

    if m.kind == "lda":
        raise ValueError("an LDA has no lexicon")
    if isinstance(lexicon, dict):
        vocab = match(m.vocab.select("word"), lexicon, [s for s in m.sentiment_labels if s in lexicon])
    else:
        vocab = m.vocab.select("word").join(lexicon.select("word", "lex"), "word", "left")
        if vocab.where(~F.col("lex").isin(*m.sentiment_labels)).limit(1).count():
            raise ValueError("a sentiment that the model does not have")
    return reset(replace(m, vocab=vocab))


def reset(m: TopicModel) -> TopicModel:
    """m before its first sweep, under a new seed."""
    return start(replace(m, seed=m.seed * (m.it + 1) + 1, docs=m.docs.drop("sentiment") if m.internal_sentiment else m.docs))


def from_lda(m: TopicModel, vocab: DataFrame, S: int = 3, gamma: float = 5.0) -> TopicModel:
    """An rJST that keeps the topic of every token of a fitted LDA; its sentiment is the lexicon's or drawn at random."""
    if m.kind != "lda":
        raise ValueError("only from an LDA")
    new = replace(m, kind="rjst", S=S, gamma=gamma, vocab=vocab, beta=tuple(b for b in m.beta_z for _ in range(S)))
    level = F.array_position(F.array(*[F.lit(s) for s in new.sentiment_labels]), F.col("lex")).cast("int") - 1
    u = F.floor(F.pmod(F.xxhash64(F.lit(m.seed + 1), F.col("doc_id"), F.col("pos")), F.lit(1 << 40)) / float(1 << 40) * S).cast("int")
    tokens = m.tokens.join(vocab.select("word", "lex"), "word", "left").select("doc_id", "pos", "word", (F.col("z") * S + F.coalesce(level, u)).cast("int").alias("z"))
    return replace(new, tokens=tokens)
