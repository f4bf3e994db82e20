"""Connected parts of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.sources import store


def connected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root: the smallest node that each node of the edges (keys, a, b) reaches, itself included.

    Each round ties every node's larger neighbours to its smallest one, then its smaller neighbours; minima are aggregated
    before the shuffle, so a node of very many edges isn't gathered. Rounds grow with the logarithm of the longest path
    and are written, so lineage stays short. Nodes of other keys never meet; edges of a node with itself play no part."""
    names = [*keys, "a", "b"]
    state = store.saved(edges.filter("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        both = state.union(state.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy(*keys, "a").agg(F.min("b").alias("m")), [*keys, "a"])
        state = store.saved(small.select(*keys, F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), "edges")
    stars = state.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(*keys, F.col("root").alias("node"), "root").distinct())
