"""Connected components of a large graph by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that it is connected with, for both ends of the edges ``a``, ``b``.

    A large star ties the larger neighbours of a node to the smallest one around it, a small star does so with the smaller
    ones; taken in turns, both turn every component into a star around its smallest node, in a number of rounds that grows with the
    logarithm of the nodes. Smallest neighbours are found by aggregation before the join, so a node of very many edges is
    no group of its own in a task. Each round is written to the shared folder.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "graph")
    while True:
        large = _star(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), large=True)
        small = stored(_star(large, large=False), "graph")
        if links.exceptAll(small).isEmpty() and small.exceptAll(links).isEmpty():
            break
        links = small
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.unionByName(roots)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Ties neighbours (those larger than the node, or those smaller and itself) to the smallest of all around it."""
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = links.join(least, "a")
    if large:
        tied = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        tied = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return tied.filter("a <> b").distinct()
