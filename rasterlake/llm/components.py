"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm import work


def _lowest(edges: DataFrame, key: str, value: str) -> DataFrame:
    return edges.groupBy(key).agg(F.min(value).alias("low"))


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable, itself included) for every node of edges (hi, lo: long).

    Both steps aggregate minima before the shuffle and join edges to one row a node, so a hub is never
    gathered in one task; each round is written as a work table. The number of rounds grows with the
    logarithm of the longest path. Self-loops and repeated edges are allowed; no edges give no rows."""
    state = work.saved(edges.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    before = None
    while True:
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if before == (now.n, now.h) or not now.n:
            break
        before = (now.n, now.h)
        both = state.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(state.select("lo", "hi"))
        low = _lowest(both, "u", "v").select("u", F.least("u", "low").alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("low").alias("lo")).distinct()
        small = large.join(_lowest(large, "hi", "lo"), "hi")
        small = small.filter("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).union(small.select("hi", F.col("low").alias("lo"))).distinct()
        state = work.saved(small, "edges")
    stars = state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
