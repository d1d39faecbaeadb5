"""Connected components of an undirected graph, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every id that occurs in ``edges``; ``component`` is the smallest id of it.

    Large-star and small-star steps alternate until nothing changes, however many rounds that takes; they
    grow with the logarithm of the longest path. Neighbours of a hub are only aggregated to their minimum
    (combined on the map side) and joined back, never gathered in one task. Self loops, repeated and
    null edges change nothing.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL").distinct())
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    e = e.where("u <> v")
    before = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut(small.select("e.u", "e.v").where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
