"""Connected components of a large edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Large-star then small-star rounds: each links a node's neighbours to the smallest of them, so the
    edge count never grows and the depth falls geometrically. Every round is a stored table in shared
    storage. A node's neighbours are never gathered: a minimum (partially aggregated) is joined back,
    so a hub is only a skewed join, which Spark splits.
    """
    edges = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = stored(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # large star: neighbours larger than u go to the smallest of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        # small star: u and its smaller neighbours go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct())
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])
