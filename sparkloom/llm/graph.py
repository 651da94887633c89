"""Connected components of a graph that no machine holds, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


#: A node's edges are dealt into so many slices where they meet what is known of the node; Spark splits larger ones further.
SLICES = 8


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the component's smallest node) of every node of edges (a, b).

    A node's least neighbour is an aggregate, combined before the shuffle, and joined back in SLICES, so a node with very many
    neighbours, as the centre of a large component is, is neither gathered nor one key. Rounds grow with the logarithm of the
    longest chain; each is written to the shared folder.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least(F.min("v"), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_least(large, F.min("v")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select("v", "v").distinct())


def _with_least(pairs: DataFrame, least: Column) -> DataFrame:
    """pairs (u, v) with m, an aggregate of u's rows."""
    found = pairs.groupBy("u").agg(least.alias("m")).select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    return pairs.withColumn("slice", F.pmod(F.xxhash64("v"), F.lit(SLICES)).cast("int")).join(found, ["u", "slice"])
