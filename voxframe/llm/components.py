"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.scratch import split_join, stored


def _least(pairs: DataFrame) -> DataFrame:
    """u, low: the least v of each u."""
    return pairs.groupBy("u").agg(F.min("v").alias("low"))


def large_star(edges: DataFrame) -> DataFrame:
    """Joins the larger neighbours of each node to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return split_join(both.where("v > u"), _least(both), "u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Joins the smaller neighbours of each node, and itself, to the least of them. edges: v below u, as large_star gives."""
    low = _least(edges)
    moved = split_join(edges, low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node is below one centre at most, and no centre is below another: then every component is one star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of long ids -> node, component: the least id it reaches; nodes without edges are absent.
    Null ids and loops are ignored; an empty table gives an empty result. One table is stored a turn."""
    now = stored(edges.where("u != v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "cc-edges")
    while not is_forest_of_stars(now):
        now = stored(small_star(large_star(now)), "cc-edges")
    # every node but the least points to it
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
