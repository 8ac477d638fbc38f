"""Nearest neighbours of embeddings by cosine: of every vector among all vectors, or of those asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = 16
#: Query vectors and other vectors that one task compares.
QUERY_BLOCK, SLICE = 10_000, 40_000
#: Queries of a block whose scores are held at once, and groups of a slice whose best bound its nearest from below.
_AT_ONCE, _GROUPS = 256, 512
#: Scores are rounded to nine places; no closer two may change places by it, or by the order of a sum.
_CLOSE = 2e-9
_BEST = "query long, neighbour long, score double, label double"


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors with their `norm`; those of norm 0 go."""
    d = vectors.withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    return d.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).filter("norm > 0").drop("v")


def _matrix(t: pa.Table, vector: str, norm: str) -> np.ndarray:
    """The vectors of a table divided by their norm."""
    if not len(t):
        return np.zeros((0, 0))
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t[vector].chunks])
    return flat.astype(float).reshape(len(t), -1) / t[norm].to_numpy()[:, None]


def _place(*keys: np.ndarray) -> np.ndarray:
    """Each row's place, from 0, among neighbouring rows of equal keys."""
    at = np.arange(len(keys[0]))
    new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)]) if len(at) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at


def _one_of_many(b: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows of a slice that may be among the `k` nearest of some query: of equal vectors those of the largest ids."""
    same = np.unique(np.ascontiguousarray(b).view(np.dtype((np.void, b.itemsize * b.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    rows = np.lexsort((-ids, same))
    rows = rows[_place(same[rows], ids[rows]) < k]
    return rows[_place(same[rows]) < 2 * k]


def _best(k: int):
    """The `k` nearest of a slice for each query of a block, products summed place by place; scores within rounding of the last stay too."""

    def near(a: np.ndarray, b: np.ndarray, asked: np.ndarray, ids: np.ndarray, by_id: np.ndarray) -> tuple:
        n, groups = len(ids), max(1, min(_GROUPS, len(ids) // 4))
        score = np.full((len(a), -(-n // groups) * groups), -np.inf)
        score[:, :n] = a @ b.T
        lo, hi = (np.searchsorted(ids[by_id], asked, side) for side in ("left", "right"))
        for j in range((hi - lo).max()):
            own = np.flatnonzero(lo + j < hi)
            score[own, by_id[lo[own] + j]] = -np.inf
        # the k-th of the groups' best is at most the k-th of all
        best = score.reshape(len(a), -1, groups).max(axis=1)
        least = np.partition(best, groups - k, axis=1)[:, groups - k] if groups >= k else np.full(len(a), -np.inf)
        r, c = np.nonzero((score >= least[:, None] - _CLOSE) & (score > -np.inf))
        exact = np.zeros(len(r))
        for i in range(a.shape[1]):
            exact += a[r, i] * b[c, i]
        order = np.lexsort((-exact, r))
        r, c, exact = r[order], c[order], exact[order]
        place = _place(r)
        last = np.full(len(a), -np.inf)
        last[r[place == k - 1]] = exact[place == k - 1]
        keep = exact >= last[r] - _CLOSE
        return r[keep], c[keep], exact[keep]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query": pa.array([], "int64"), "neighbour": pa.array([], "int64"), "score": pa.array([], "float64"), "label": pa.array([], "float64")})
        asked, ids, a, b = left["query"].to_numpy(), right["vec_id"].to_numpy(), _matrix(left, "q", "q_norm"), _matrix(right, "v", "v_norm")
        rows = _one_of_many(b, ids, k)
        b, ids = b[rows], ids[rows]
        by_id = np.argsort(ids, kind="stable")
        found = [(r + i, c, s) for i in range(0, len(a), _AT_ONCE) for r, c, s in [near(a[i : i + _AT_ONCE], b, asked[i : i + _AT_ONCE], ids, by_id)]]
        r, c, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": asked[r], "neighbour": ids[c], "score": score, "label": right["label"].cast("double").take(pa.array(rows[c]))})

    return best


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(query, rank, neighbour, score): of each row of `queries` the k nearest others by score, ties to the larger id.

    Blocks of queries meet slices of all vectors, every pair once; a slice hands on its k nearest of each query and what ties with them.
    Of a slice's equal vectors, and of rows of one id, more than could be handed on are left out.
    """
    u, asked = unit(vectors), unit(queries)
    blocks, slices = -(-asked.count() // QUERY_BLOCK) or 1, -(-u.count() // SLICE) or 1
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.col("norm").alias("q_norm"), part("vec_id", blocks).alias("block"), each(slices).alias("slice")).groupBy("block", "slice")
    right = u.select("vec_id", "label", F.col("embedding").alias("v"), F.col("norm").alias("v_norm"), part("vec_id", slices).alias("slice"), each(blocks).alias("block")).groupBy("block", "slice")
    d = left.cogroup(right).applyInArrow(_best(k), _BEST).withColumns({"score": F.round("score", 9), "label": F.col("label").cast(vectors.schema["label"].dataType)})
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("neighbour"))
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_of_all(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """`neighbours` of every vector."""
    return neighbours(vectors, vectors, k)


def nearest(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """`neighbours` of the vectors whose id is divisible by 100; no query asks for these alone."""
    return neighbours(vectors, vectors.filter("vec_id % 100 = 0"), k)


def cost_median(vectors: DataFrame) -> DataFrame:
    """Median label of the neighbours; null under four."""
    d = nearest_of_all(vectors).groupBy("query").agg(F.count("*").alias("n"), F.median(F.col("label").cast("double")).alias("m"))
    return d.select("query", F.when(F.col("n") >= 4, F.col("m")).alias("cost_median"))
