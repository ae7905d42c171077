"""Connected components by label propagation with pointer jumping, in DataFrame operations.

Defined cases: no edges give no nodes; edges may repeat, lead back or join a node with itself; null ends are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component: the smallest node reachable, for every node with an edge.

    Every round lowers each node's label to the smallest among its neighbours' and then to its label's label, so that
    the number of rounds grows with the logarithm of the longest path. Tables of earlier rounds are removed.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    n = 2 * edges.count()  # nodes too are no more than that
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges", n)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels", n)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        lower = stored(lower, "labels", n)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        new = stored(lower.join(jump, "label").select("node", "was", F.least("label", "beyond").alias("label")), "labels", n)
        discard(labels, lower)
        labels = new
        if labels.filter("label <> was").isEmpty():
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
