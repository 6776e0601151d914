"""Connected components of an edge table by alternating large-star and small-star rounds; of a small one at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import discard, materialise, path_of


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).head())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges a, b in ascending order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        # A root with a smaller one beside it goes below the smallest; of the roots that have edges half remain at most.
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def connected_components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """edges: a, b (long, not null, any direction, may repeat). Returns node, root: the smallest node that it reaches.

    Nodes without an edge to another node do not appear. Each round is written as a table, so lineage stays short;
    a round's edges number no more than the nodes and edges before it, and the rounds grow with the logarithm of the
    nodes. Only a count and a checksum reach the driver, and the edges (16 bytes each) if there are `at_once` or fewer:
    these make no rounds, of several shuffles each.
    """
    now = materialise(edges.where("a != b").select("a", "b").distinct(), "cc")
    seen = _signature(now)
    if 0 < seen[0] <= at_once:
        held = now.toArrow()
        node, root = least_reached(*(np.asarray(held.column(c)) for c in ("a", "b")))
        out = now.sparkSession.createDataFrame(pa.table({"node": node, "root": root}))
        return materialise(out, "cc")
    while seen[0]:
        before, now = now, materialise(_small_star(_large_star(now)), "cc")
        discard(now.sparkSession, [path_of(before)])
        mark = _signature(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
