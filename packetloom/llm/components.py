"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them (edges point downwards)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).toDF("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node of ``edges`` (a long, b long) but the roots, with its least reachable node.

    Each round is sums by key and joins, some log(nodes) of them; tables between the rounds
    are written to the shared folder. Self-links, nulls and repeated links do not matter; no
    links give no rows.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(down.distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.toDF("node", "root")
