"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise, remove


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one v only, and no v is a u: then the edges are stars around the smallest nodes of their components."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the smallest node of its component.

    Every round is two grouped minima and two joins over slim rows, written to the shared folder; the tables of a round go once the
    next one is written. Edges that are stars already take no round. The number of rounds grows with the logarithm of the largest component. Edges with a null end are left
    out. Joins with a hub's minimum are plain equi-joins, which adaptive execution splits where a hub is skewed.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    ).distinct()
    edges = materialise(edges, "edges")
    rounds = 0
    while not _settled(edges):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        rounds += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        remove(last)
        remove(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def spanning_forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a block's edges (a, b) connect something that earlier ones don't."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[y] = x
            keep.append(k)
    return np.array(keep, np.int64)
