"""Connected components of an edge table as a series of small joins, never gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot_keys import join_aggregate
from .workspace import discard, saved

EDGE = "a long, b long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of each Arrow batch: every node that is not its root, with its root."""
    for batch in batches:
        ends = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        nodes, places = np.unique(ends, return_inverse=True)
        parent = list(range(len(nodes)))
        for a, b in places.reshape(2, -1).T.tolist():
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[max(a, b)] = min(a, b)
        for n in range(len(nodes)):  # parents precede their children
            parent[n] = parent[parent[n]]
        roots = nodes[np.array(parent, np.int64)] if len(nodes) else nodes
        moved = roots != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], names=["a", "b"])


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component, for edges (a, b) of longs.

    First each task replaces its edges by a spanning forest (union-find). Then rounds of two steps, until nothing
    changes: every node passes its larger neighbours to its smallest one, then every node passes its smaller
    neighbours to the smallest of them. Both keep components as they are and the number of edges from growing, and
    leave stars in a number of rounds that grows with the logarithm of the nodes. A node's neighbours are joined
    with their minimum, a partial aggregate, in such a way that a node of a great many neighbours can be split.
    """
    tree = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_forest, EDGE).distinct(), "edges")
    if tree.isEmpty():
        return tree.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = tree.select("a", "b").union(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = join_aggregate(both, least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
        large = large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = join_aggregate(large, lowest, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        after = saved(small, "edges")
        discard(tree)
        # stars: no node has two edges up, and no root is below another
        up = after.groupBy("a").agg(F.count("*").alias("n"))
        if up.filter("n > 1").isEmpty() and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        tree = after
