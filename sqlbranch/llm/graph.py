"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task gathers before it replaces them by a spanning forest.
FOREST_EDGES = 1 << 20


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge (node, smallest node of its tree) for each node, with the components of the edges u - v."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:  # the smaller label over each edge, then pointers halve their way; labels only fall
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    keep = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[keep], nodes[label[keep]]


def _thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components, at most one for each node that a task has seen."""

    def thin(batches):
        held, size = [], 0
        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += batch.num_rows
            if size >= FOREST_EDGES:
                held = [spanning_forest(*(np.concatenate(x) for x in zip(*held)))]
                if len(held[0][0]) > FOREST_EDGES // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                    held = []
                size = sum(len(x[0]) for x in held)
        if held:
            u, v = spanning_forest(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(thin, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the edges (u, v, both long) the smallest node that it is connected with.

    Alternates large-star and small-star steps until all edges point at roots, which takes a number of rounds logarithmic in the length of the
    longest path in practice. A hub costs a row for each neighbour; no group of edges is gathered in one task. An edge from a
    node to itself gives a component of one; null ends are dropped; no edges give no rows.
    """
    loops = edges.filter("u = v").select("u").distinct()
    now = cut(_thinned(edges.filter("u != v").select(F.col("u").cast("long"), F.col("v").cast("long"))))
    seen = None
    while True:
        both = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
        # small star: what a node points at, and itself, points at the least of them
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        small = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = small.filter("u != v").distinct()
        # large star: larger neighbours point at the least of all neighbours
        mutual = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mutual.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        now = cut(mutual.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    roots = nodes.select(F.col("root").alias("node"), "root").distinct()
    found = nodes.unionByName(roots)
    return found.unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("root")).join(found.select("node"), "node", "left_anti"))
