"""Connected components of an edge table by alternating stars, with lineage cut in every round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, even_lookup


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of `edges`; root is the smallest node reachable.

    Each round links every node's larger neighbours to its smallest neighbour, then its smaller ones; paths shrink
    geometrically. A node with many links is reduced by a partial aggregate and meets its links by key and salt. Nulls are no
    nodes, loops and repeated edges do no harm, and an empty table has no components.
    """
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct()
    pairs, before = cut_lineage(pairs), None
    while True:
        both = pairs.union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u"))).toDF("node", "other")
        large = _stars(both, F.col("other") > F.col("node"))
        small = _stars(large.select(F.col("v").alias("node"), F.col("u").alias("other")), F.lit(True))
        pairs = cut_lineage(small)
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).union(pairs.select("u", "u").distinct())
        before = now


def _stars(links: DataFrame, moved) -> DataFrame:
    """Links (node, other) with `moved` become links from other to node's smallest neighbour or itself."""
    least = links.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    joined = even_lookup(links, least, ["node"])
    shifted = joined.where(moved).select(F.col("other").alias("v"), F.col("least").alias("u"))
    return shifted.union(least.select(F.col("node").alias("v"), F.col("least").alias("u"))).where("u < v").distinct()


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, the smallest node that each one reaches."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
