"""Connected components of a stored edge table, by shrinking stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import settled


def connected(edges: DataFrame) -> DataFrame:
    """(node, group): each end of ``edges`` (a, b) with the least node that it
    is connected to.

    Every round links each node to the least node among its neighbours' (large
    star, then small star); the number of rounds grows with the logarithm of
    the longest path. Only the count of changed edges reaches the driver.
    """
    edges = settled(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: larger neighbours go to the least of the neighbourhood
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # small star: a node and its smaller neighbours go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a")
        small = down.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = settled(small.where("a != b").distinct())
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        edges = after
        if same:
            break
    found = edges.groupBy("a").agg(F.min("b").alias("group")).select(F.col("a").alias("node"), "group")
    roots = found.select("group").distinct().select(F.col("group").alias("node"), "group")
    return settled(found.unionByName(roots))
