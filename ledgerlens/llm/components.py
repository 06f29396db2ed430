"""Connected components of a link table by alternating star contraction.

Every round replaces each node's links by links to the smallest node it
sees: first for its larger neighbours, then for its smaller ones. The
link table never grows, and ends as one star per component after a number
of rounds that grows with the logarithm of the longest path. Minima are
pre-aggregated before the shuffle and brought back by a join, so that a
node with very many links is split like any skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.materialize import materialize, release


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter("b > a").join(least, "a").filter("b <> m")
            .select(F.col("m").alias("a"), "b"))


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` with a < b: every smaller neighbour a of b moves to the
    smallest one."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none."""
    ends = links.select(F.col("b").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("a", F.lit(0), F.lit(1)))
    unsettled = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter(
        "up > 1 or (up = 1 and down = 1)")
    return not unsettled.limit(1).count()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)`` other than
    the smallest one of its component; ``component`` is that smallest node.
    Links are undirected and may repeat; a link of a node to itself or with
    a null end says nothing. An empty table gives no rows."""
    current = materialize(links.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not _settled(current):
        starred = materialize(_large_star(current).distinct(), "links")
        following = materialize(_small_star(starred), "links")
        release(current, starred)
        current = following
    return current.select(F.col("b").alias("node"), F.col("a").alias("component"))
