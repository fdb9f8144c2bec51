"""Connected components of a table of links, as joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.tools import durable


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches; labels: the result for earlier links, which is extended."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, root): the smallest node reachable from each linked node.

    Each node points to its smallest neighbour if that is smaller, so pointers make trees; pointers are followed, twice
    as far each time, to the trees' roots. Then each tree is one node, and what links are left between trees go into the
    next round. A round's hot keys (the centres of large stars) are split by the adaptive skew join. All
    tables are written out, which cuts their lineage.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, labels = durable(ends, "links"), None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "pointers")
        moved = True
        while moved:
            next_ = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = durable(up.join(next_, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
            moved = not jumped.where("moved").isEmpty()
            up = jumped.select("node", "to")
        if labels is None:
            labels = up.withColumnRenamed("to", "root")
        else:
            higher = up.select(F.col("node").alias("root"), "to")
            labels = durable(labels.join(higher, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        left, right = up.select(F.col("node").alias("a"), F.col("to").alias("x")), up.select(F.col("node").alias("b"), F.col("to").alias("y"))
        mapped = edges.join(left, "a").join(right, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        edges = durable(mapped.distinct(), "links")
        if edges.isEmpty():
            return labels
