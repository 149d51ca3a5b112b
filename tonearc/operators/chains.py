"""Several chains of one model: distances between their topics, scores, a map of the chains."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearc.functions import ragged
from tonearc.functions.shared import saved
from tonearc.model import TopicModel
from tonearc.operators import posterior as P
from tonearc.operators.coherence import coherence, cooccurrence, npmi
from tonearc.operators.summary import top_word_index

METHODS = ("euclidean", "hellinger", "cosine", "minMax", "naiveEuclidean", "invariantEuclidean")


def assignment(cost: np.ndarray) -> tuple[float, list[int]]:
    """Least-cost assignment of rows to columns (Hungarian method, shortest augmenting paths)."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            row = match[j]
            free = ~used[1:]
            slack = cost[row - 1] - u[row] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            nxt = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    to = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            to[match[j] - 1] = j - 1
    return float(sum(cost[i, to[i]] for i in range(n))), to


def leaf_distances(a: DataFrame, b: DataFrame, method: str) -> DataFrame:
    """(i, j, d) between all leaves of two phi tables (word, z, p): Z x Z rows, computed by words in Spark."""
    value = F.sqrt("p") if method == "hellinger" else F.col("p")
    side = lambda df, name: df.groupBy("word").agg(F.collect_list(F.struct(F.col("z").cast("int").alias("z"), value.cast("double").alias("p"))).alias(name))
    both = saved(side(a, "a").join(side(b, "b"), "word", "full").select("a", "b"), "phi-pairs")  # each chain is computed once
    leaves = [np.array(sorted(r[0] for r in both.select(F.explode(f"{c}.z")).distinct().collect()), int) for c in ("a", "b")]

    def dense(batch, name: str, own: np.ndarray) -> np.ndarray:
        bounds, cells = ragged.flat(batch, name)
        out = np.zeros((batch.num_rows, len(own)))
        out[np.repeat(np.arange(batch.num_rows), np.diff(bounds)), np.searchsorted(own, cells.field("z").to_numpy(zero_copy_only=False))] = cells.field("p").to_numpy(zero_copy_only=False)
        return out

    def sums(batches):
        z, y = leaves
        apart, dot, xx, ww = np.zeros((len(z), len(y))), np.zeros((len(z), len(y))), np.zeros(len(z)), np.zeros(len(y))
        for batch in batches:
            x, w = dense(batch, "a", z), dense(batch, "b", y)
            for i in range(len(z)):
                apart[i] += ((x[:, i : i + 1] - w) ** 2).sum(axis=0)
            dot, xx, ww = dot + x.T @ w, xx + (x * x).sum(axis=0), ww + (w * w).sum(axis=0)
        i, j = (k.ravel() for k in np.meshgrid(np.arange(len(z)), np.arange(len(y)), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(z[i].astype(np.int32)), pa.array(y[j].astype(np.int32)), *(pa.array(v) for v in (apart[i, j], dot[i, j], xx[i], ww[j]))], ["i", "j", "s", "xw", "xx", "ww"])

    per = both.mapInArrow(sums, "i int, j int, s double, xw double, xx double, ww double").groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("s", "xw", "xx", "ww")])
    if method == "cosine":
        return per.select("i", "j", F.round(1 - F.col("xw") / F.sqrt(F.col("xx") * F.col("ww")), 15).alias("d"))
    return per.select("i", "j", (F.sqrt("s") / (2**0.5 if method == "hellinger" else 1.0)).alias("d"))


def naive_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the sum of Euclidean distances of leaves of equal index."""
    both = a.select("word", "z", F.col("p").alias("pa")).join(b.select("word", "z", F.col("p").alias("pb")), ["word", "z"], "full").na.fill(0.0, ["pa", "pb"])
    per = both.groupBy("z").agg(F.sqrt(F.sum((F.col("pa") - F.col("pb")) ** 2)).alias("d"))
    return per.agg(F.sum("d").alias("distance"))


def min_max_distance(d: DataFrame) -> DataFrame:
    """One row: the largest distance of a leaf to its nearest one, both ways; d as of leaf_distances."""
    rows, cols = d.groupBy("i").agg(F.min("d").alias("d")), d.groupBy("j").agg(F.min("d").alias("d"))
    return rows.select("d").unionByName(cols.select("d")).agg(F.max("d").alias("distance"))


def _matrix(d: DataFrame, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    for r in d.collect():
        out[r.i, r.j] = r.d
    return out


def distance(m: TopicModel, a: DataFrame, b: DataFrame, method: str = "euclidean", aggregate: str = "sum") -> float:
    """Between two chains of m, by their phi tables. invariantEuclidean only permutes what the model leaves open: topics
    (with all their sentiments) of an rJST with a lexicon, topics inside each sentiment of a JST with one, both without;
    aggregate (sum or max) applies to the first, the others take the largest."""
    if method not in METHODS:
        raise ValueError(method)
    if method == "naiveEuclidean":
        return float(naive_distance(a, b).first()[0])
    d = _matrix(leaf_distances(a, b, method if method in ("hellinger", "cosine") else "euclidean"), m.Z)
    if method == "minMax":
        return float(max(d.min(axis=0).max(), d.min(axis=1).max()))
    if method != "invariantEuclidean" or m.L2 == 1:
        return assignment(d)[0]
    lexicon = m.vocab.where(F.col("lex").isNotNull()).limit(1).count() > 0
    blocks = d.reshape(m.L1, m.L2, m.L1, m.L2)
    if lexicon and m.kind == "rjst":
        cost = np.einsum("isjs->ij", blocks)
        _, to = assignment(cost)
        own = [cost[i, to[i]] for i in range(m.L1)]
        return float(sum(own) if aggregate == "sum" else max(own))
    if lexicon:
        return float(max(assignment(blocks[i, :, i, :])[0] for i in range(m.L1)))
    nested = np.array([[assignment(blocks[i, :, j, :])[0] for j in range(m.L1)] for i in range(m.L1)])
    _, to = assignment(nested)
    return float(max(nested[i, to[i]] for i in range(m.L1)))


def chain_distances(chains: list[TopicModel], method: str = "euclidean", aggregate: str = "sum", truth: DataFrame | None = None) -> np.ndarray:
    """Symmetric matrix over chains; truth (word, z, p), if given, is one chain more, the last."""
    tables = [P.phi(c).select("word", "z", "p").cache() for c in chains] + ([truth] if truth is not None else [])
    out = np.zeros((len(tables),) * 2)
    for i, j in itertools.combinations(range(len(tables)), 2):
        out[i, j] = out[j, i] = distance(chains[0], tables[i], tables[j], method, aggregate)
    for t in tables[: len(chains)]:
        t.unpersist()
    return out


def chain_scores(chains: list[TopicModel], n: int = 10, window: int | None = 110) -> DataFrame:
    """chain, last and largest log-likelihood, mean C_NPMI and C_V; co-occurrence is counted once for all chains.
    window=None takes each metric's own window."""
    spark, rows = chains[0].docs.sparkSession, []
    top = top_word_index(chains[0], n).select("word")
    for c in chains[1:]:
        top = top.unionByName(top_word_index(c, n).select("word"))
    top = top.distinct().cache()
    tables = {w: npmi(cooccurrence(chains[0].tokens, w, top, chains[0].vocab.select("word"))).cache() for w in {window or 10, window or 110}}
    for i, c in enumerate(chains):
        value = {k: coherence(c, n, k, npmis=tables[window or w]).agg(F.avg("value")).first()[0] for k, w in (("C_NPMI", 10), ("C_V", 110))}
        logs = [sum(x) for x in c.loglik] or [float("nan")]
        rows.append((i + 1, logs[-1], max(logs), value["C_NPMI"], value["C_V"]))
    return spark.createDataFrame(rows, "chain int, loglik_last double, loglik_max double, c_npmi double, c_v double")


def chain_map(distances: np.ndarray) -> np.ndarray:
    """Coordinates of three chains or more in the plane by classical scaling."""
    n = len(distances)
    if n < 3:
        raise ValueError("a map needs three chains or more")
    centre = np.eye(n) - 1 / n
    value, vector = np.linalg.eigh(-0.5 * centre @ (distances**2) @ centre)
    best = np.argsort(value)[::-1][:2]
    return vector[:, best] * np.sqrt(np.maximum(value[best], 0))

