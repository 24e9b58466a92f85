"""Connected components of a graph of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours hung on the node's smallest neighbour; edges(u, v) have u > v."""
    seen = edges.select("u", "v")
    if both_ways:
        seen = seen.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = seen.join(least, "u")
    if both_ways:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes that hang on two others, or on one that hangs itself; without any all components are stars."""
    several = edges.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v < w").select("u")
    return several.unionAll(edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi"))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs, in either direction, to (node, component): the smallest node reachable; a row for each node with an edge.

    Every step is a table in the shared folder; the driver sees whether any node
    still hangs on one that hangs itself. The number of steps grows with the
    logarithm of the longest path.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while _unfinished(now).limit(1).count():
        now = staged(_stars(_stars(now, True).distinct(), False).distinct(), "stars")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionAll(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
