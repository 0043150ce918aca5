"""Connected groups of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestkit.session import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select("b", "a"))


def connected(links: DataFrame) -> DataFrame:
    """``a, b`` (long) → ``node, leader``: the smallest node each linked node can reach.

    Every round lets each node point at its smallest neighbour, follows the pointers to their ends (doubling the steps a
    pointer spans) and contracts the links to these ends. All but the smallest node of a neighbourhood disappear in a
    round, so few rounds are needed; each is cut off from its lineage.
    """
    edges = cut_lineage(links.where("a != b").distinct())
    found = None
    while not edges.isEmpty():
        ways = cut_lineage(_both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("leader")))
        while True:
            ends = ways.select(F.col("node").alias("leader"), F.col("leader").alias("_further")).where("leader != _further")
            moved = cut_lineage(ways.join(ends, "leader", "left").select("node", F.coalesce("_further", "leader").alias("leader"), F.col("_further").isNotNull().alias("_moved")))
            ways = moved.drop("_moved")
            if moved.where("_moved").isEmpty():
                break
        if found is None:
            found = ways
        else:
            onward = ways.select(F.col("node").alias("leader"), F.col("leader").alias("_further"))
            found = cut_lineage(found.join(onward, "leader", "left").select("node", F.coalesce("_further", "leader").alias("leader")))
        left, right = (ways.select(F.col("node").alias(c), F.col("leader").alias(f"_{c}")) for c in "ab")
        edges = cut_lineage(edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a != b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("leader")) if found is None else found
