"""Connected components of a link table, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsay.shared import staged


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node) of every node in ``links`` (columns ``a``, ``b``: longs, any order).

    Large-star and small-star steps alternate until the links stop changing: every node then points to its least one.
    The minimum of a node's neighbours is an aggregate that combines before the shuffle, and it is joined back by
    a plain join, which adaptive execution splits where a node has very many neighbours.  Loops and repeated links
    are harmless; null ends are ignored.
    """
    ordered = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = staged(ordered.distinct())
    mark = _mark(now)
    while mark[0]:
        now = staged(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    smaller = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
