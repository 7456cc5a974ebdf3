"""Connected components of edges that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolecall.session import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour instead."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least")).select(
        "node", F.least("node", "least").alias("least"))
    return (both.join(least, "node").where("other > node")
            .select(F.col("other").alias("high"), F.col("least").alias("low")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").select(
        F.when(F.col("low") == F.col("least"), F.col("high")).otherwise(F.col("low")).alias("high"),
        F.col("least").alias("low"))
    return moved.where("high != low").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and none that hangs holds others."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("low").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not nodes.agg(F.max((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0)))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have edges; the component is the
    smallest node of it. The first two columns of ``edges`` are its ends.

    Large and small stars in turn until every node hangs on the smallest one of
    its component. Each round is a few joins and aggregates over the edges and
    is written to the shared folder; the driver sees whether another is needed. Edges
    with a null end and loops count for nothing.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    held = Scratch(edges.sparkSession)
    stars = held.table(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(
        F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
    while not _settled(stars):
        after = Scratch(edges.sparkSession)
        stars = after.table(_small_star(_large_star(stars)), "stars")
        held.clear()
        held = after
    return stars.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        stars.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
