"""Connected components by alternating stars: each round links a node's neighbours to the smallest of
them, so that long paths shrink by a constant factor. Every round is a distributed aggregate and join,
cut by a reliable checkpoint; nothing but the sign that all are stars comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """``(a, m)``: the least neighbour of each node, itself included; partial sums come first."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least(both), "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")  # made distinct by the small star


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_least(down), "a")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(joined.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _not_stars(edges: DataFrame) -> DataFrame:
    """The nodes with a second smaller neighbour, or with both a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    )
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1 and below > 0")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the edges ``(a, b)``; component: the smallest node."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    stars = edges.where("a != b").select("a", "b")
    while True:
        stars = cut_lineage(_small_star(_large_star(stars)))
        if _not_stars(stars).isEmpty():
            break
    # a converged star has every node but its centre once in a
    root = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
