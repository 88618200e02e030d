"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.cluster import stored


def _state(links: DataFrame) -> tuple:
    """Tells one set of distinct links from another."""
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(row)


def _round(links: DataFrame) -> DataFrame:
    """A large star, then a small star, over links a < b.

    Large: a node's greater neighbours are hung on the least of it and all its neighbours. Small: a node and its lesser neighbours
    are hung on the least of these. Both keep the components, and paths shrink by about half.
    """
    sides = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("next")))
    least = sides.groupBy("node").agg(F.min("next").alias("least")).where("least < node")
    large = links.join(least.withColumnRenamed("node", "a"), "a", "left") \
        .select(F.coalesce("least", "a").alias("a"), "b").distinct()
    low = large.groupBy("b").agg(F.min("a").alias("least"))
    small = large.join(low, "b").select("least", F.explode(F.array("a", "b")).alias("b")).where("least < b")
    return small.select(F.col("least").alias("a"), "b").distinct()


def components(links: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) with a != b; root is the least node that it is connected to.

    Alternating large and small stars: a chain of n links takes about log2(n) rounds, one job each over a table that never has
    more links than the first. A hot node meets a minimum that is combined before the exchange. Every round is a written table, so a plan
    has one round's depth and the statistics of its files. ``rounds`` gets the number of links after each round.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    before, done = _state(links), False
    while not done:
        links = stored(_round(links), "links")
        after = _state(links)
        done, before = after == before, after
        if rounds is not None:
            rounds.append(after[0])
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
