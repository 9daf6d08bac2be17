"""Connected components: per-task forests and a distributed contraction.

Pairs found inside one task are first reduced to a forest there
(:func:`local_roots`); what is left is contracted with DataFrame joins
(:func:`components`).  Nothing is gathered on the driver but counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches over the edges a-b (and those already in ``root``)."""
    root = np.arange(n) if root is None else root.copy()
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (a long, b long) that isn't its component's smallest.

    Each round, a node hooks to its smallest smaller neighbour; the hooks, a
    forest, are flattened by pointer jumping, and the edges are rewritten
    between roots.  Hooks are kept as files, so the joins see exchanges on both
    sides and a root with very many nodes is split.
    """
    edges = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    found = None
    while not edges.isEmpty():
        hooks = settled(edges.groupBy("u").agg(F.min("v").alias("p")))
        while True:
            above = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
            hooks = settled(hooks.join(above, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            moved = not hooks.where("moved").isEmpty()
            hooks = hooks.drop("moved")
            if not moved:
                break
        up = hooks.select(F.col("u").alias("root"), "p")
        new = hooks.select(F.col("u").alias("node"), F.col("p").alias("root"))
        found = settled(new if found is None else found.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")).unionByName(new))
        edges = edges.join(hooks.select("u", F.col("p").alias("pu")), "u").join(hooks.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v", "left")
        edges = edges.select(F.col("pu").alias("a"), F.coalesce("pv", "v").alias("b")).where("a <> b")
        edges = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")) if found is None else found
