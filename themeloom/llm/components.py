"""Connected components of a graph held in tables.

Edges are rewired by alternating large and small stars until every node points at the
smallest node it reaches. Each step is one aggregation and one join; both sides of a join
are read from tables, so Spark splits the rows of a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from themeloom.workspace import Workspace


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b). Loops and null ends are ignored,
    repeated edges count once."""
    space = space.part()
    ends = edges.where(F.col("a") != F.col("b"))
    now = space.table(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "e0")
    seen, step = None, 0
    while seen != (state := _checksum(now)):
        seen, step = state, step + 1
        now = space.table(_small_star(space, _large_star(space, now, step), step), f"e{step}")
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _large_star(space: Workspace, edges: DataFrame, step: int) -> DataFrame:
    """Point all larger neighbours of a node at the smallest node among it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = space.table(least.select("a", F.least("a", "m").alias("m")), f"large{step}")
    larger = both.where(F.col("b") > F.col("a")).join(least, "a")
    return space.table(larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"l{step}")


def _small_star(space: Workspace, edges: DataFrame, step: int) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them."""
    least = space.table(edges.groupBy("a").agg(F.min("b").alias("m")), f"small{step}")
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
