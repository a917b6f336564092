"""Connected components of a link table, by rounds of joins over staged tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.staging import Stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the given ones, fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[left], label[right]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(stage: Stage, links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Each round looks up the grandparent of every node, lets every node see its neighbours'
    grandparents, and hooks it and its parent to the smallest.  Sums per node are combined
    before the shuffle and every join reads staged tables, so a hub's rows can be split.
    Rounds grow with the logarithm of the longest chain.  No links: no rows.
    """
    both = stage.put("links", links.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").distinct())
    parents = stage.put("parents", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("parent")))
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        seen = stage.put("grand", parents.join(up, "parent").select("node", "parent", "grand"))
        around = both.join(seen.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("low"))
        state = stage.put("state", seen.join(around, "node"))
        if state.filter("low < grand or grand < parent").isEmpty():
            return state.select("node", F.col("grand").alias("component"))
        hooks = state.select(F.explode(F.array(F.struct(F.col("parent").alias("node"), F.col("low").alias("to")), F.struct(F.col("node"), F.least("low", "grand").alias("to")))).alias("x"))
        parents = stage.put("parents", hooks.groupBy("x.node").agg(F.min("x.to").alias("parent")))
