"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import checkpointed, swept


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in edges (a, b longs).

    Large-star and small-star steps take turns until the edges stay as they are: each id is linked to
    the smallest neighbour known. Edges are kept in the shared folder between steps;
    the driver sees only their number and a checksum. Minima are combined before the shuffle and joins on a
    hot id can be split, so a component may hold any share of the ids. No edges: an empty result.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        near = both.join(low, "a")
        moved = near.where(F.col("b") > F.col("a") if large else F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.where("a != m").select("a", F.col("m").alias("b"))
        out = moved.unionByName(own) if not large else moved
        return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before = None
    while True:
        edges = checkpointed(star(star(edges, True), False).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        swept(edges.sparkSession)
        if now == before:
            break
        before = now
    # at the fixed point every edge goes from an id to its component's smallest
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
