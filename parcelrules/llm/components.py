"""Connected components of an edge table, by alternating star contractions.

Each round is joins and grouped minima; the edges are written to the shared
folder after each, which also cuts the lineage. Nothing goes to the driver but
whether any edge is left to move. Rounds are few: every shuffle costs the driver
a thread and its memory, whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelrules.llm import common as c
from parcelrules.operators.skew import splittable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); the root is the least node of its component."""
    now = c.materialised(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                         "edges", narrow=True)
    while not settled(now):
        now = c.materialised(small_star(large_star(now)), "edges", narrow=True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def settled(edges: DataFrame) -> bool:
    """No node hangs on two others, and none that another hangs on hangs itself: every component is a star on its least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where(
        "hangs + holds > 1 AND hangs > 0").isEmpty()


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the least node around."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(splittable(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(
        "u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(splittable(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
