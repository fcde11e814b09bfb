"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges(a, b)``; a component is named by its smallest node.

    Each round a node takes the smallest name among its own and its neighbours'
    and then the name that this one has, so that names travel in leaps.
    """
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    names = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(names.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        closer = names.join(near, "node").select("node", F.col("component").alias("_was"), F.least("component", "_near").alias("component"))
        far = names.select(F.col("node").alias("component"), F.col("component").alias("_far"))
        leapt = checkpointed(closer.join(far, "component").select("node", "_was", F.col("_far").alias("component")))
        names = leapt.drop("_was")
        if leapt.where("component != _was").isEmpty():
            return names
