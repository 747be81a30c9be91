"""Connected components of a link table, by star contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop_table, shared_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in `links` (a, b); the component is its smallest node.

    Each round links all larger neighbours of a node to its smallest neighbour, then all smaller
    neighbours and the node itself to the smallest (large star, small star); the links end as stars
    around the smallest nodes after a number of rounds about the logarithm of the longest path.
    Links are pre-aggregated to one row per node before they are dealt.
    """
    links = shared_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("low").alias("y"))
        large = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("low").alias("y")), F.struct(F.col("a").alias("x"), F.col("low").alias("y")))).alias("e"))
        small = small.select(F.col("e.y").alias("a"), F.col("e.x").alias("b")).where("a < b").distinct()
        new = shared_table(small, "links")
        if new.count() == links.count() and new.exceptAll(links).isEmpty():
            ends = new.select(F.col("b").alias("node"), F.col("a").alias("component"))
            drop_table(links)
            return ends.unionByName(new.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        drop_table(links)
        links = new
