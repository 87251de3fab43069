"""Graph operators over edge tables: components and greedy leaders.

Both run in rounds of joins and aggregations. The driver sees one count a
round; rounds are cut by checkpoints so that plans do not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import settled


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest id that a node can reach.

    ``nodes`` has ``id``; ``edges`` has ``a`` and ``b``, in any direction, with
    loops and repeats allowed. Each round takes the smallest label of the
    neighbours and then the label of that label, so that long chains shorten
    by jumps. Nodes without an edge are their own component.
    """
    both = edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    both = settled(both)
    labels = settled(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("further"))
        moved = settled(low.join(jump, "low").select("id", F.col("component").alias("was"), F.least("low", "further").alias("component")))
        labels = moved.select("id", "component")
        if moved.where("was <> component").isEmpty():
            break
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def greedy_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, leader)``: what one pass in order of ``rank`` gives, in which each
    free node leads and takes every free neighbour.

    ``nodes`` has ``id`` and a unique ``rank``; ``edges`` has ``a`` and ``b`` in
    any direction. A node leads iff none of its earlier neighbours does. Each
    round settles all nodes without an open earlier neighbour, who lead, and
    their neighbours, who follow; all chains go forward at once. In the end a
    follower joins the first leader among its neighbours.
    """
    order = nodes.select("id", "rank")
    pairs = edges.select("a", "b").where("a <> b").join(order.toDF("a", "rank_a"), "a").join(order.toDF("b", "rank_b"), "b")
    late, early = F.when(F.col("rank_a") > F.col("rank_b"), F.col("a")).otherwise(F.col("b")), F.when(F.col("rank_a") > F.col("rank_b"), F.col("b")).otherwise(F.col("a"))
    pairs = settled(pairs.select(late.alias("late"), early.alias("early"), F.least("rank_a", "rank_b").alias("rank")).distinct())
    still, followers = pairs.select("late", "early"), None
    while not still.isEmpty():
        # An early end that is no late end of an open pair leads; its late ends follow.
        follow = settled(still.join(still.select(F.col("late").alias("early")), "early", "left_anti").select("late").distinct())
        followers = follow if followers is None else settled(followers.union(follow))
        # Pairs of a follower bind no longer, on either side.
        still = settled(still.join(follow, "late", "left_anti").join(follow.select(F.col("late").alias("early")), "early", "left_anti"))
    if followers is None:
        return nodes.select("id", F.col("id").alias("leader"))
    # All who do not follow lead, so a follower's leader is the first of its earlier neighbours that does not.
    first = pairs.join(followers.select(F.col("late").alias("early")), "early", "left_anti").groupBy(F.col("late").alias("id")).agg(F.min_by("early", "rank").alias("leader"))
    return nodes.select("id").join(first, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))
