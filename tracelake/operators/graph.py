"""Ranks over the files of each conversation. Graphs are small and many: a task holds one of them at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAMPING = 0.85
ROUNDS = 80
TOLERANCE = 1e-7


def ident_weight(name: Column, definers: Column, in_task: Column) -> Column:
    """The weight of an edge by an identifier: a tenth if more than five files define it, a tenth for a leading underscore, threefold for
    eight characters or more, threefold if the task names it."""
    one = lambda c, w: F.when(c, w).otherwise(1.0)
    return one(definers > 5, 0.1) * one(name.startswith("_"), 0.1) * one(F.length(name) >= 8, 3.0) * one(in_task, 3.0)


def ranks(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """PageRank by power iteration; what nodes without edges out hold is spread over all."""
    out = np.bincount(src, weight, n)
    share = weight / np.where(out[src] == 0, 1, out[src])
    r = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        new = (1 - DAMPING + DAMPING * r[out == 0].sum()) / n + DAMPING * np.bincount(dst, r[src] * share, n)
        new /= new.sum()
        done = np.abs(new - r).max() < TOLERANCE
        r = new
        if done:
            break
    return r


def pagerank(edges: DataFrame) -> DataFrame:
    """(conv, node, rank) from (conv, src, dst, weight); equal edges are summed before they meet."""
    e = edges.groupBy("conv", "src", "dst").agg(F.sum("weight").alias("weight"))

    def run(frame: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        nodes, at = np.unique(np.concatenate([frame["src"], frame["dst"]]), return_inverse=True)
        r = ranks(at[: len(frame)], at[len(frame) :], frame["weight"].to_numpy(float), len(nodes))
        return pd.DataFrame({"conv": frame["conv"].iloc[0], "node": nodes, "rank": np.round(r, 9)})

    return e.groupBy("conv").applyInPandas(run, "conv long, node string, rank double")


def derived_edges(lineitem: DataFrame) -> DataFrame:
    """Edges between an order line's part and its order, as files of its supplier's conversation, by an identifier of the line."""
    name = F.concat(F.when(F.col("l_linenumber") % 3 == 0, "_").otherwise(""), F.lit("name"), F.repeat(F.lit("x"), F.col("l_linenumber").cast("int")))
    weight = ident_weight(name, F.col("l_partkey") % 9, F.col("l_orderkey") % 4 == 0)
    return lineitem.select(F.col("l_suppkey").alias("conv"), F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("src"), F.concat(F.lit("f"), (F.col("l_orderkey") % 37).cast("string")).alias("dst"), weight.alias("weight"))
