"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node in ``edges(a, b)``.

    Rounds grow with the square of the logarithm of the number of nodes at most (Kiveris et al.); every round that changes a
    link gives a node a smaller neighbour, so the loop ends. A node with very many
    neighbours is pre-aggregated, and the joins back are ones that adaptive execution can split.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = saved(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "large")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = saved(small.filter("u > v").distinct(), "links")
        state = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after)]
        now = after
        if state[0] == state[1]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
