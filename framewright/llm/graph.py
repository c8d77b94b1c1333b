"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import materialize

#: Edges that one task takes at once (4 MB); more go through rounds over all tasks.
ONE_TASK = 1 << 18


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, ascending, and the smallest node that each one reaches: larger roots
    are hooked to smaller ones and paths are shortened until no edge joins two roots."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while (open_ := up[a] != up[b]).any():
        a, b = a[open_], b[open_]
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


def _smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [pdf.to_numpy(np.int64) for pdf in batches]
    if parts:
        node, root = smallest(*np.concatenate(parts).T)
        yield pd.DataFrame({"node": node, "root": root})


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the edges (u, v).

    Up to ONE_TASK edges are joined in one task. Of more, every round, each node takes its smallest
    neighbour (or itself) for a parent, parents are followed twice, and the edges move to the
    parents; edges within one component vanish. Each round is cut by a table in the shared folder.
    Stars and cliques end in two or three rounds, long chains in about the logarithm of their length.
    """
    edges = materialize(edges.select("u", "v").filter("u <> v"), "edges")
    if edges.count() <= ONE_TASK:
        return materialize(edges.coalesce(1).mapInPandas(_smallest, "node long, root long"), "roots")
    edges = materialize(edges.distinct(), "edges")
    found: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = materialize(
            both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("p")), "parents"
        )
        for _ in range(2):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p").select("node", F.col("q").alias("p"))
        parent = materialize(parent, "parents")
        if found is None:
            found = parent.withColumnRenamed("p", "root")
        else:
            up = parent.select(F.col("node").alias("root"), "p")
            found = found.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        found = materialize(found, "roots")
        pu = parent.select(F.col("node").alias("u"), F.col("p").alias("a"))
        pv = parent.select(F.col("node").alias("v"), F.col("p").alias("b"))
        moved = edges.join(pu, "u").join(pv, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = materialize(moved.filter("u <> v").distinct(), "edges")
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found
