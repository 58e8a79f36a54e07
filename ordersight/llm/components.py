"""Connected components of an edge table by random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs to (node, root): one root for all nodes that the edges connect, in any order.

    Every round gives each node the neighbour (or itself) with the smallest seeded hash as its parent and
    contracts the edges to the parents. A constant share of the nodes vanishes per round whatever the shape
    of the graph, so the rounds grow with the logarithm of the longest path. Parents of each round are kept
    and composed from the last round back; the tables shrink geometrically. A hub costs one row per task in
    the grouping; joins on a hub are split by adaptive execution.
    """
    left = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct())
    rounds = []
    while not left.isEmpty():
        def rank(c, seed=len(rounds)):
            return F.xxhash64(F.col(c), F.lit(seed))
        both = left.union(left.select("b", "a")).toDF("node", "other")
        best = both.groupBy("node").agg(F.min_by("other", rank("other")).alias("other"))
        parent = durable(best.select("node", F.when(rank("other") < rank("node"), F.col("other"))
                                     .otherwise(F.col("node")).alias("parent")))
        rounds.append(parent)
        to = [parent.select(F.col("node").alias(k), F.col("parent").alias(p)) for k, p in (("a", "pa"), ("b", "pb"))]
        moved = left.join(to[0], "a").join(to[1], "b").where("pa <> pb")
        left = durable(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("parent").alias("root"))
    for parent in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("parent"), "root")
        roots = durable(parent.join(later, "parent", "left")
                        .select("node", F.coalesce("root", "parent").alias("root")))
    return roots
