"""Connected components of a link table by alternating large and small stars; no group or table leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, tidy
from ..session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over (a, b) with a > b: each node's neighbours (larger ones, or smaller ones and itself) meet its minimum."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        out = (edges.join(least, edges["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return out.where("a > b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the least node reachable by links; nodes without a link to another node are not listed.

    Each round replaces the edge table of the one before.
    """
    edges, before = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b"), None
    while True:
        edges = cut_lineage(_stars(_stars(edges, True), False))
        if before is not None:
            forget(before)
        before = edges
        # Done once every node has one parent and no parent has a parent.
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.agg(F.max(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("int"))).first()[0]:
            break
    tidy(links.sparkSession)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
