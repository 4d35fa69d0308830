"""Connected components of a graph of links, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, salted_join

LINKS_PER_TASK = 100_000
#: The links of a node that has many are dealt over so many tasks.
SALTS = 8


def _toward_least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both directions of the links (u, v), and for each u the least of itself and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both, least


def _large_star(links: DataFrame) -> DataFrame:
    both, least = _toward_least(links)
    return salted_join(both, least, "u", "v", SALTS).filter("v > u").select(F.col("v").alias("b"), F.col("m").alias("a")).filter("a < b").select("a", "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = salted_join(links, least, "b", "a", SALTS).select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its least node.

    Each round rewires links toward the least neighbour; the number of rounds grows with the
    logarithm of the graph, and they go on until one changes nothing.  Lineage is cut every
    round.  Rounds only ever have about as many links as there are, so tasks are as many as
    those fill; the links of a hub are dealt over ``SALTS`` of them.
    """
    now = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    tasks = -(-max(1, now.count()) // LINKS_PER_TASK)
    now, mark = now.coalesce(tasks), None
    while True:
        now = cut(_small_star(_large_star(now)).coalesce(tasks))
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
