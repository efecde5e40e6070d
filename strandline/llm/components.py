"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 16))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): each node of an edge with the least node it can reach.

    Every round replaces edges by edges to lesser nodes and writes them to the
    shared folder; the number of rounds grows with the logarithm of the longest
    path, and they go on until none changes an edge.  A node's neighbours are never gathered: minima are partial sums and
    the joins behind them are ones that Spark splits where a node is hot.
    """
    edges = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", thin=True)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: the greater neighbours of a node go to its least one
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: the lesser neighbours of a node, and the node, go to its least one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = materialize(small, "cc", thin=True)
        now = _state(edges)
        if now == state:
            break
        state = now
    labels = edges.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())


def joins(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs x, y that join the labelled components to as few as all pairs would, and the labels then."""
    labels, taken = labels.copy(), []
    left = np.flatnonzero(labels[x] != labels[y])
    while len(left):
        parent: dict[int, int] = {}

        def top(k: int) -> int:
            while parent.get(k, k) != k:
                k = parent[k]
            return k

        # one pair for each component at a time
        _, one = np.unique(labels[x[left]], return_index=True)
        for p in left[one].tolist():
            a, b = top(int(labels[x[p]])), top(int(labels[y[p]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                taken.append(p)
        names = np.unique(labels)
        labels = np.array([top(int(k)) for k in names])[np.searchsorted(names, labels)]
        left = left[labels[x[left]] != labels[y[left]]]
    return np.array(taken, np.int64), labels
