"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def union(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the classes of u[i] and v[i] in place; labels[i] <= i is a root's place."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (u, v) of longs; label is the least node of its component.

    Each round hooks the roots of both ends of the edges between two trees to
    the lesser one and halves the paths to the roots. Nothing is gathered: all
    joins read checkpointed tables on both sides, so that a node with very many
    edges is dealt out by Spark's skewed-join handling; hooks are minima, which
    are aggregated before they are sent.
    """
    edges = cut(edges.filter("u <> v").select("u", "v").distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    labels = cut(labels.select("node", F.least("node", "least").alias("label")))
    while True:
        labels = _flat(labels)
        left = labels.select(F.col("node").alias("u"), F.col("label").alias("a"))
        right = labels.select(F.col("node").alias("v"), F.col("label").alias("b"))
        apart = edges.join(left, "u").join(right, "v").filter("a <> b")
        hooks = apart.groupBy(F.greatest("a", "b").alias("root")).agg(F.min(F.least("a", "b")).alias("to"))
        hooks = cut(hooks)
        if hooks.isEmpty():
            return labels
        moved = labels.join(hooks, labels["label"] == hooks["root"], "left")
        labels = cut(moved.select("node", F.coalesce("to", "label").alias("label")))


def _flat(labels: DataFrame) -> DataFrame:
    """Each node's label becomes its root."""
    while True:
        up = labels.filter("node <> label").select(F.col("node").alias("at"), F.col("label").alias("to"))
        if labels.join(up, labels["label"] == up["at"], "left_semi").isEmpty():
            return labels
        moved = labels.join(up, labels["label"] == up["at"], "left")
        labels = cut(moved.select("node", F.coalesce("to", "label").alias("label")))
