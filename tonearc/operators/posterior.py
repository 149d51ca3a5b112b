"""Counts and posteriors of a model, and their inversion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearc.functions import ragged
from tonearc.functions.shared import saved
from tonearc.functions.special import lgamma
from tonearc.model import TopicModel
from tonearc.operators.corpus import with_rank


def _doubles(values) -> F.Column:
    return F.array(*[F.lit(float(v)) for v in values])


def count_zw(m: TopicModel) -> DataFrame:
    return m.tokens.where(F.col("word").isNotNull()).groupBy("z", "word").agg(F.count(F.lit(1)).alias("n"))


def count_zd(m: TopicModel) -> DataFrame:
    return m.tokens.where(F.col("word").isNotNull()).groupBy("doc_id", "z").agg(F.count(F.lit(1)).alias("n"))


def _dense(m: TopicModel, key: str, base: DataFrame) -> DataFrame:
    """base with z and n for every leaf: one aggregation with a column per leaf, no cross join."""
    some = m.tokens.where(F.col("word").isNotNull()).groupBy(key).agg(*[F.count_if(F.col("z") == z).alias(f"n{z}") for z in range(m.Z)])
    wide = base.join(some, key, "left")
    counts = F.array(*[F.coalesce(F.col(f"n{z}"), F.lit(0)) for z in range(m.Z)])
    return wide.select(*base.columns, F.posexplode(counts).alias("z", "n"))


def doc_l1(m: TopicModel) -> DataFrame:
    """(doc_id, l1, n, p), dense: p = (n + prior) / (N + sum of priors); an empty document has the prior mean."""
    prior = F.element_at(_doubles(m.l1_prior), F.col("l1") + 1)
    p = (F.col("n1") + prior) / (F.col("total") + float(sum(m.l1_prior)))
    return _doc_leaves(m).where(F.col("l2") == 0).select("doc_id", "l1", F.col("n1").alias("n"), p.alias("p"))


def _doc_leaves(m: TopicModel) -> DataFrame:
    """(doc_id, z, l1, l2, n, n1: of the l1, total), dense."""
    some = m.tokens.where(F.col("word").isNotNull()).groupBy("doc_id").agg(*[F.count_if(F.col("z") == z).alias(f"n{z}") for z in range(m.Z)])
    wide = m.docs.select("doc_id").join(some, "doc_id", "left")
    n = [F.coalesce(F.col(f"n{z}"), F.lit(0)) for z in range(m.Z)]
    add = lambda cols: sum(cols[1:], cols[0])
    by_l1 = [add(n[i * m.L2 : (i + 1) * m.L2]) for i in range(m.L1)]
    leaf = [F.struct(F.lit(z).alias("z"), F.lit(z // m.L2).alias("l1"), F.lit(z % m.L2).alias("l2"), n[z].alias("n"), by_l1[z // m.L2].alias("n1"), add(n).alias("total")) for z in range(m.Z)]
    return wide.select("doc_id", F.explode(F.array(*leaf)).alias("x")).select("doc_id", "x.*")


def doc_mixtures(m: TopicModel) -> DataFrame:
    """(doc_id, l1, l2, l1_p, l2_p, p): both layers of every document in one pass over the tokens."""
    a, g = m.l1_prior, m.l2_prior
    sums = [sum(g[i * m.L2 : (i + 1) * m.L2]) for i in range(m.L1)]
    at = lambda values, c: F.element_at(_doubles(values), F.col(c) + 1)
    x = _doc_leaves(m).withColumn("l1_p", (F.col("n1") + at(a, "l1")) / (F.col("total") + float(sum(a))))
    l2_p = F.lit(1.0) if m.L2 == 1 else (F.col("n") + at(g, "z")) / (F.col("n1") + at(sums, "l1"))
    return x.withColumn("l2_p", l2_p).select("doc_id", "l1", "l2", "l1_p", "l2_p", (F.col("l1_p") * F.col("l2_p")).alias("p"))


def doc_l2(m: TopicModel) -> DataFrame:
    """(doc_id, l1, l2, n, p): p = (n + prior) / (n of the l1 + sum of its priors); 1 where there is one l2."""
    g = m.l2_prior
    sums = [sum(g[i * m.L2 : (i + 1) * m.L2]) for i in range(m.L1)]
    at = lambda values, c: F.element_at(_doubles(values), F.col(c) + 1)
    p = F.lit(1.0) if m.L2 == 1 else (F.col("n") + at(g, "z")) / (F.col("n1") + at(sums, "l1"))
    return _doc_leaves(m).select("doc_id", "l1", "l2", "n", p.alias("p"))


def word_counts(m: TopicModel) -> DataFrame:
    """(word, lex, z, n, beta), dense over vocabulary and leaves; beta is 0 where the lexicon keeps a word out."""
    beta = F.when(m.allowed(), F.element_at(_doubles(m.beta_z), F.col("z") + 1)).otherwise(0.0)
    return _dense(m, "word", m.vocab.select("word", "lex")).withColumn("beta", beta)


def phi_cells(m: TopicModel) -> DataFrame:
    """(word, z, n, beta, p), dense: p = (n + beta) / (n of the leaf + sum of its betas)."""
    cells = word_counts(m)
    totals = cells.groupBy("z").agg(F.sum("n").alias("n_z"), F.sum("beta").alias("beta_z"))  # a row per leaf
    return cells.join(F.broadcast(totals), "z").select("word", "z", "n", "beta", ((F.col("n") + F.col("beta")) / (F.col("n_z") + F.col("beta_z"))).alias("p"))


def phi(m: TopicModel) -> DataFrame:
    """(word, z, l1, l2, n, p) of phi_cells()."""
    return phi_cells(m).select("word", "z", m.l1().alias("l1"), m.l2().alias("l2"), "n", "p")


# ---- likelihood ------------------------------------------------------------------------------------------------------


def loglik_words(m: TopicModel, eps: float = 1e-9) -> DataFrame:
    """(z, value): log-likelihood of each leaf's words under its betas, kept away from 0 by eps."""
    cells = word_counts(m).withColumn("x", lgamma(F.col("n") + F.col("beta") + eps) - lgamma(F.col("beta") + F.lit(eps)))
    per = cells.groupBy("z").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("beta").alias("b"))
    return per.select("z", (F.col("x") + lgamma("b") - lgamma(F.col("n") + F.col("b"))).alias("value"))


def loglik_l1(m: TopicModel, multinomial: bool = False) -> DataFrame:
    """(doc_id, value): log-likelihood of each document's first layer under its prior; multinomial: with the coefficient
    of the counts, so that it is the probability of the counts instead of that of one order."""
    return _loglik_layer(doc_l1(m), ["doc_id"], "l1", m.l1_prior, None, multinomial)


def loglik_l2(m: TopicModel, multinomial: bool = False) -> DataFrame:
    """(doc_id, l1, value): the same of the second layer in each part of the first; 0 where there is one l2."""
    x = doc_l2(m).withColumn("z", F.col("l1") * m.L2 + F.col("l2"))
    sums = [sum(m.l2_prior[i * m.L2 : (i + 1) * m.L2]) for i in range(m.L1)]
    return _loglik_layer(x, ["doc_id", "l1"], "z", m.l2_prior, sums, multinomial)


def _loglik_layer(x: DataFrame, keys: list[str], part: str, prior, sums, multinomial: bool) -> DataFrame:
    own = F.element_at(_doubles(prior), F.col(part) + 1)
    order = lgamma(F.col("n") + F.lit(1.0)) if multinomial else F.lit(0.0)
    per = x.withColumn("_g", lgamma(F.col("n") + own) - lgamma(own) - order).groupBy(*keys).agg(F.sum("_g").alias("_g"), F.sum("n").alias("_n"))
    whole = F.lit(float(sum(prior))) if sums is None else F.element_at(_doubles(sums), F.col("l1") + 1)
    coefficient = lgamma(F.col("_n") + F.lit(1.0)) if multinomial else F.lit(0.0)
    return per.select(*keys, (F.col("_g") + lgamma(whole) - lgamma(F.col("_n") + whole) + coefficient).alias("value"))


# ---- inversion -------------------------------------------------------------------------------------------------------


def l1_counts(mixtures: DataFrame, lengths: DataFrame, prior) -> DataFrame:
    """(doc_id, l1, n): counts from mixtures (doc_id, l1, p) and lengths (doc_id, length)."""
    return mixtures.join(lengths, "doc_id").select("doc_id", "l1", (F.col("p") * (F.col("length") + float(sum(prior))) - F.element_at(_doubles(prior), F.col("l1") + 1)).alias("n"))


def l2_counts(mixtures: DataFrame, n1: DataFrame, prior, L1: int) -> DataFrame:
    """(doc_id, l1, l2, n): counts from mixtures (doc_id, l1, l2, p) and those of the first layer (doc_id, l1, n); prior:
    of all leaves."""
    width = len(prior) // L1
    own = F.element_at(_doubles(prior), F.col("l1") * width + F.col("l2") + 1)
    sums = [sum(prior[i : i + width]) for i in range(0, len(prior), width)]
    return mixtures.join(n1.withColumnRenamed("n", "_n1"), ["doc_id", "l1"]).select("doc_id", "l1", "l2", (F.col("p") * (F.col("_n1") + F.element_at(_doubles(sums), F.col("l1") + 1)) - own).alias("n"))


def word_counts_from_phi(phi_table: DataFrame, totals: DataFrame) -> DataFrame:
    """(word, z, n) from phi (word, z, p, beta) and totals (z, n_z)."""
    beta = phi_table.groupBy("z").agg(F.sum("beta").alias("beta_z"))
    return phi_table.join(F.broadcast(beta), "z").join(F.broadcast(totals), "z").select("word", "z", (F.col("p") * (F.col("n_z") + F.col("beta_z")) - F.col("beta")).alias("n"))


def largest_remainder(values: np.ndarray, total: int) -> np.ndarray:
    """Non-negative integers close to values that sum to total."""
    v = np.maximum(values, 0)
    v = v * total / v.sum() if v.sum() > 0 else np.full(len(v), total / max(len(v), 1))
    low = np.floor(v).astype(int)
    low[np.argsort(-(v - low), kind="stable")[: total - low.sum()]] += 1
    return low


def _largest_remainders(values: np.ndarray, bounds: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """largest_remainder() of many lists laid end to end, each with its own total."""
    sizes, rows = np.diff(bounds), np.repeat(np.arange(len(totals)), np.diff(bounds))
    v = np.maximum(values, 0)
    sums = np.bincount(rows, weights=v, minlength=len(totals))
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(sums[rows] > 0, v * totals[rows] / sums[rows], totals[rows] / sizes[rows])
    low = np.floor(v).astype(np.int64)
    missing = totals - np.bincount(rows, weights=low, minlength=len(totals)).astype(np.int64)
    order = np.lexsort((-(v - low), rows))  # stable: equal remainders in order of items
    low[order[(np.arange(len(v)) - bounds[:-1][rows]) < missing[rows]]] += 1
    return low


def repair(counts: DataFrame, key: str, item: str, totals: DataFrame, keep: bool = False) -> DataFrame:
    """Fractional counts (key, item, n) made integers that sum to total (key, total) within each key; keep: with _x, the
    fractions. Many keys at once: a list of items for each."""
    kinds = dict(counts.dtypes)

    def fix(batches):
        for b in (x for batch in batches for x in ragged.pieces(batch, "x")):
            bounds, parts = ragged.flat(b, "x")
            n = parts.field("n").to_numpy(zero_copy_only=False).astype(float)
            whole = _largest_remainders(n, bounds, b.column("total").to_numpy(zero_copy_only=False).astype(np.int64))
            own = b.column(key).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(bounds))))
            yield pa.RecordBatch.from_arrays([own, parts.field(item), pa.array(whole), *([pa.array(n)] if keep else [])], [key, item, "n", *(["_x"] if keep else [])])

    lists = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(item, F.col("n").cast("double").alias("n")))).alias("x"))
    return lists.join(totals.select(key, F.col("total").cast("long").alias("total")), key).mapInArrow(fix, f"{key} {kinds[key]}, {item} {kinds[item]}, n long" + (", _x double" if keep else ""))


#: Units that move at once by a plain sort; more are taken by ranks, which no single task holds.
UNITS = 50_000


def repair_margins(counts: DataFrame, key: str, item: str, totals: DataFrame, item_totals: dict[int, int]) -> DataFrame:
    """Fractional counts (key, item, n) made integers that sum to total (key, total) within each key and to item_totals
    within each item, which must agree in all. Rows are rounded first; then units move from items that have too many to
    items that have too few, where the fractions are hurt least. Items are few (topics): one pass for each pair of them,
    over what the pass before left in the shared folder."""
    now = saved(repair(counts, key, item, totals, keep=True), "repaired")
    have = {r[item]: int(r["n"]) for r in now.groupBy(item).agg(F.sum("n").alias("n")).collect()}
    over = {i: n - item_totals.get(i, 0) for i, n in have.items()}
    if sum(over.values()):
        raise ValueError("the margins do not agree")
    while any(over.values()):
        source, target = max(over, key=over.get), min(over, key=over.get)
        units = min(over[source], -over[target])
        both = now.where(F.col(item).isin(source, target)).groupBy(key).agg(*[F.max(F.when(F.col(item) == i, F.col(c))).alias(f"{c}{k}") for k, i in ((0, source), (1, target)) for c in ("n", "_x")])
        hurt = (F.col("_x0") - F.col("n0")) - (F.col("_x1") - F.col("n1"))
        free = both.where("n0 > 0").select(key, hurt.alias("_hurt"))
        first = free.orderBy("_hurt", key).limit(units) if units <= UNITS else with_rank(free, "_place", "_hurt", key).where(F.col("_place") < units)
        moved = saved(first.select(key, F.lit(True).alias("_moved")), "moved")
        done = moved.count()
        if not done:
            raise ValueError("no counts are left to move")
        change = F.when(F.col(item) == source, -1).when(F.col(item) == target, 1).otherwise(0)
        now = saved(now.join(moved, key, "left").withColumn("n", F.col("n") + F.when(F.col("_moved"), change).otherwise(0)).drop("_moved"), "repaired")
        over[source] -= done
        over[target] += done
    return now.select(key, item, "n")


def _faults(m: TopicModel, detailed: bool) -> DataFrame:
    """One row of how many tokens are out of range (za), of unknown words (toks), or where the lexicon keeps them out
    (lex). Tokens are counted by word first: only those counts are joined with the vocabulary. detailed: null leaves are
    out of range, and the lexicon judges only what is in range."""
    inside = (F.col("z") >= 0) & (F.col("z") < m.Z)
    judged = inside if detailed else F.col("z").isNotNull()
    at = [F.count_if(judged & (m.sentiment("z") == k)).alias(f"s{k + 1}") for k in range(-1, m.S)]
    own = m.tokens.where(F.col("word").isNotNull()).groupBy("word")
    counts = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(~inside, F.lit(detailed))).alias("out"), F.count_if(judged).alias("judged"), *at)
    level = F.array_position(F.array(*[F.lit(s) for s in m.sentiment_labels]), F.col("lex"))
    kept = F.lit(False) if m.kind == "lda" else F.col("lex").isNotNull()
    wrong = F.when(kept, F.col("judged") - F.element_at(F.array(*[F.col(f"s{k + 1}") for k in range(-1, m.S)]), (level + 1).cast("int"))).otherwise(0)
    joined = counts.join(m.vocab.select("word", "lex", F.lit(True).alias("_known")), "word", "left")
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)
    return joined.agg(total("out", "za"), total(F.when(F.col("_known").isNull(), F.col("n")).otherwise(0), "toks"), total(wrong, "lex"))


def integrity(m: TopicModel, detailed: bool = False) -> DataFrame:
    """One row of flags: za (assignments in range), toks (all words known), lex (lexicon kept), l1, l2, phi (sums of 1);
    detailed: how many tokens (za, toks, lex), documents, parts of documents and leaves are at fault instead."""
    words = _faults(m, detailed)
    if detailed:
        odd = lambda c: F.count_if(F.coalesce(F.abs(F.col(c) - 1) >= 1.5e-8, F.lit(True)))
        out = words
        for x, keys, name in ((doc_l1(m), ["doc_id"], "l1"), (doc_l2(m), ["doc_id", "l1"], "l2"), (phi(m), ["z"], "phi")):
            out = out.join(F.broadcast(x.groupBy(*keys).agg(F.sum("p").alias("s")).agg(odd("s").alias(name))))  # rows of one
        return out
    near = lambda c: F.abs(F.col(c) - 1) < 1.5e-8
    l1 = doc_l1(m).groupBy("doc_id").agg(F.sum("p").alias("s")).agg(F.every(near("s")).alias("l1"))
    l2 = doc_l2(m).groupBy("doc_id", "l1").agg(F.sum("p").alias("s")).agg(F.every(near("s")).alias("l2"))
    ph = phi(m).groupBy("z").agg(F.sum("p").alias("s")).agg(F.every(near("s")).alias("phi"))
    out = words.select(*[(F.col(c) == 0).alias(c) for c in ("za", "toks", "lex")])
    for one in (l1, l2, ph):  # rows of one
        out = out.join(F.broadcast(one))
    return out
