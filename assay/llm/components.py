"""Connected components over an edge table: few links in one bounded task, more by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialise

#: Each round at least halves the distance to the smallest id; more rounds than this mean a fault, not a large graph.
MOST_ROUNDS = 60
#: Links (of 16 bytes) that one task holds and joins up whole, however many partitions they come in; more go through rounds of stars.
FEW_LINKS = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes of the links (u, v) and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots hang on smaller ones
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [batch[["u", "v"]].to_numpy("int64") for batch in batches]
    links = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
    nodes, least = least_reachable(links[:, 0], links[:, 1])
    yield pd.DataFrame({"node": nodes, "component": least})


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b (long). Returns node, component (the smallest id reachable) for every node with a link to another.

    Up to ``FEW_LINKS`` links, repeated ones included, are read by one task. Beyond it, minima are combined before they are shuffled, hubs take
    theirs by a broadcast, and every round ends in a written table. Self-links and nulls are ignored; repeated links count once; no links give no rows.
    """
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")), "links")
    if e.count() <= FEW_LINKS:
        return materialise(e.coalesce(1).mapInPandas(_in_one_task, "node long, component long"), "components")
    e = materialise(e.distinct(), "links")
    state = _state(e)
    for _ in range(MOST_ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "stars")
        near = _with_least(large, 2 * state[0])
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(near.where("v = m").select("u", "v"))
        e = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Each edge with m, the least v of its u; a hub's edges are not gathered (``total`` bounds their number)."""
    return join_hot(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "u", total)
