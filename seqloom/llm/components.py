"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b. Every node keeps an edge to the smallest node it sees."""
    e = edges
    if large:  # each node tells its larger neighbours of the smallest node around it
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return e.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a")
    keep = least.select("a", F.col("m").alias("b"))
    return keep.unionByName(moved.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) in any direction to (node, label): label is the smallest node of the component.

    Nodes without links have no row. Self links and repeated links are ignored. Each round is written to the shared
    folder; nothing is collected but two numbers a round.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage(edges, "edges")
    before = None
    while True:
        edges = stage(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
