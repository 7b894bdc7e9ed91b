"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.session import drop_staged, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest node reachable.

    Large-star then small-star until the edges no longer change: every round links each node's larger
    neighbours (then its smaller ones) to the smallest node it knows, so rounds grow with the logarithm of
    the graph. Each step is a grouped minimum with map-side combine and a join of edges with one row per
    node, whose skewed partitions Spark splits. Each round is written to the shared folder and the one
    before it deleted. Ids may be of any
    orderable type; nulls and self-links are ignored; an empty table gives an empty result."""
    u, v = F.col("u"), F.col("v")
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u > v).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large.where(u != v), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).where(u != v).distinct(), "edges")
        drop_staged(edges.sparkSession, now, large)
        now = new
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    return (now.select(u.alias("node"), v.alias("component"))
            .unionByName(now.select(v.alias("node"), v.alias("component"))).distinct())
