"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        before, edges = edges, stored(_small_star(_large_star(edges)), "stars")
        discard(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def joined_by(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, component) after more links (a, b): only the components that these join are worked on."""
    if links.isEmpty():
        return components
    at = lambda node, name: components.select(F.col("node").alias(node), F.col("component").alias(name))
    named = links.join(at("a", "x"), "a", "left").join(at("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    moved = connected_components(named).select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = components.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # Nodes that had no link so far stand for themselves.
    fresh = moved.join(components.select(F.col("component")).distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("to").alias("component"))
    return stored(old.unionByName(fresh), "joined")
