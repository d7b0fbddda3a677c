"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is two aggregations and two equi-joins, so that a node with many
links is never gathered in one task: minima are combined before the shuffle and
written, one row for each node. The join back of all links with that table is a
broadcast where the table is small, else a join of two plain shuffles that
adaptive execution splits at a node with many links. Steps end as soon as all
links are stars around the least node, which one aggregation tells; links that
are stars from the start take no step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = scratch.put(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m")))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")), low


def _small_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = scratch.put(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))), low


def _stars(links: DataFrame) -> bool:
    """Whether every node of ``links(a, b)``, ``a > b``, either has one link down and none up, or only links up."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down")).unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("down")))
    of = ends.groupBy("node").agg(F.sum("down").alias("times"), F.min("down").alias("least"))
    return of.filter("times > 1 OR (times = 1 AND least = 0)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the least node reachable.

    Null ends and loops are ignored; repeated links count once. An empty table
    gives an empty result.
    """
    proper = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = scratch.put(proper.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        # a large star gives one row for each link, so that only the small star's rows need to be made distinct
        after, low = _large_star(now, scratch)
        large = scratch.put(after.filter("a <> b"))
        scratch.drop(now, low)
        after, low = _small_star(large, scratch)
        now = scratch.put(after.filter("a <> b").distinct())
        scratch.drop(large, low)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
