"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.session import stored


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` for every end of the links ``a``, ``b`` (numbers); one label for each component.

    In a round every node points to the neighbour, or itself, that a hash puts first, and links are redrawn between
    what their ends point to. The hash changes with the round, so each round leaves a fixed share of the nodes at most,
    in chains too. Minima are pre-aggregated, so a node with very many links is no hot task; joins have one row per
    node on one side, so Spark may split the other. Each round is written to the shared folder. Links that have a
    null end or lead to themselves are ignored.
    """
    links = stored(links.filter("a <> b").select("a", "b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        salt = F.lit(len(rounds))
        both = links.union(links.select("b", "a"))
        ranked = both.select(
            F.col("a").alias("node"),
            F.least(F.struct(F.xxhash64("a", salt), "a"), F.struct(F.xxhash64("b", salt), F.col("b").alias("a"))).alias("m"),
        )
        point = stored(ranked.groupBy("node").agg(F.min("m").alias("m")).select("node", F.col("m.a").alias("p")), "points")
        rounds.append(point)
        one = point.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        two = point.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        redrawn = links.join(one, "a").join(two, "b").filter("pa <> pb")
        ends = redrawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        links = stored(ends.distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    found = rounds[-1].select("node", F.col("p").alias("label"))
    for point in reversed(rounds[:-1]):
        after = found.select(F.col("node").alias("p"), "label")
        found = point.join(after, "p", "left").select("node", F.coalesce("label", "p").alias("label"))
    return found
