"""Connected components of a table of links, in Spark: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestkit.llm.common import written


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links every node's larger (smaller) neighbours to the smallest in its neighbourhood."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = both.join(least, "a")
    if larger:
        return near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    linked = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (long) → ``node, component``: the smallest node reachable, for every node that has a link.

    Each round writes its links; rounds go on until a round changes nothing, which takes few when links are stars.
    """
    greater = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    current, state = written(greater, "links"), None
    while True:
        current = written(_star(_star(current, True), False), "links")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
