"""Connected components of an edge table by alternating stars.

Large star: every node links its larger neighbours to its smallest one. Small star: every node links its smaller
neighbours and itself to the smallest. Both keep the components; repeated, each component becomes one star around its
smallest node. A node of any degree is an aggregate and a join, never one task's list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhush.sources.scratch import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = out.filter("a <> b")
    return out if large else out.distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or linked to one centre only."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("centre"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("centre")))
    seen = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("centre").alias("centre"))
    return seen.filter("child > 1 or child + centre > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable. Self-links and repeats do no harm."""
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(e):
        e = materialize(_star(_star(e, True), False), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
