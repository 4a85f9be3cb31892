"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregate and a join over the edges; nothing is collected. Every node ends up linked to the
smallest id of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """For each ``u``: the smaller of itself and its smallest neighbour ``v``."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns ``a``, ``b``); component is its smallest node."""
    down = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        large = materialize(large, "large")
        small = (
            large.join(_least(large), "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        small = materialize(small, "small")
        # A star forest: every node has one edge, and no centre hangs on another.
        tips = small.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        row = tips.agg(F.max("n").alias("n")).first()
        down = small
        if row["n"] is None:
            break
        if row["n"] == 1 and small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    centres = down.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
