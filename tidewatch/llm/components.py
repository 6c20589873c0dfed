"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, component) of every node of an edge; the component is its smallest node.

    Each round is two aggregations, whose partial results bound what a hub sends, and two joins of written tables, whose
    skewed keys adaptive execution splits. The number of rounds grows with the logarithm of a component's size. Rounds end
    when the edges are stars: no node has two edges upwards, and no centre has one.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """Points all of a node's neighbours, and the node, at the smallest of them."""
        least = workspace.materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        return pairs.join(least, "u")

    def is_star(pairs: DataFrame) -> bool:
        if not pairs.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return False
        return pairs.select("v").distinct().join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()

    now = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = workspace.materialize(now, "edges")
    while not is_star(now):
        both = workspace.materialize(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = workspace.materialize(star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = star(large).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        last, now = now, workspace.materialize(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        workspace.discard(last, both, large)
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return workspace.materialize(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops), "components")
