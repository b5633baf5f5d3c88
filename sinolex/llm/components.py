"""Connected components of an edge table, kept in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinolex.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """From (a, b) to (node, component): the smallest node reachable. Nodes without an edge are not listed.

    Each round gives every node its smallest neighbour, follows these pointers to their ends by doubling, and replaces the
    edges' ends by what they lead to. A round leaves at most half of the nodes, and doubling takes the logarithm of the
    longest chain, so chains and stars alike are gone in a few rounds.
    """
    edges = durable(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("to"))
        lowest = durable(lowest)
        while True:
            ahead = lowest.select(F.col("node").alias("to"), F.col("to").alias("next"))
            followed = durable(lowest.join(ahead, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            lowest = followed.select("node", "to")
            if followed.where("moved").isEmpty():
                break
        if labels is None:
            labels = lowest.select("node", F.col("to").alias("component"))
        else:
            moved = labels.join(lowest.withColumnRenamed("node", "component"), "component", "left")
            labels = durable(moved.select("node", F.coalesce("to", "component").alias("component")))
        left = edges.join(lowest.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("x"), "b")
        pairs = left.join(lowest.withColumnRenamed("node", "b"), "b").select("x", F.col("to").alias("y"))
        edges = durable(pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if labels is None else labels
