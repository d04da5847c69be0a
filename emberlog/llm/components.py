"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked to the smallest of the node and its neighbours; large: only larger ones,
    small: only smaller ones and the node itself. Reads (a, b) as undirected where large, as b <= a where small."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.where("m < a").select("a", F.col("m").alias("b"))
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge between different nodes, the smallest node that it reaches.

    Rounds grow with the logarithm of the longest chain. Each round's edges are written to the shared folder; a hub's
    edges are never gathered, only aggregated to their minimum.
    """
    now = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        mid = saved(_star(now, True), "edges")
        after = saved(_star(mid, False), "edges")
        # a fixed point is a set of stars: every node once on the left, and no centre on the left
        change = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() + after.groupBy("a").count().where("count > 1").limit(1).count()
        release(now, mid)
        now = after
        if not change:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
