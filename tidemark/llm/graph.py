"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of edges (a, b: long, not null).

    In each round every node points to the least of itself and its neighbours, pointers are followed twice, and edges
    move to where their ends point; edges within a component vanish, and components at least halve. Nothing is
    collected; the only figure that the driver sees is whether edges are left."""
    left = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    found = None
    while True:
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        point = ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("to"))
        for _ in range(2):
            onward = point.select(F.col("node").alias("to"), F.col("to").alias("onward"))
            point = point.join(onward, "to").select("node", F.col("onward").alias("to"))
        point = settle(point)
        if found is None:
            found = point.select("node", F.col("to").alias("root"))
        else:
            moved = point.select(F.col("node").alias("root"), "to")
            found = settle(found.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        at_a = left.join(point.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        at_b = at_a.join(point.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        left = settle(at_b.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if left.isEmpty():
            return found
