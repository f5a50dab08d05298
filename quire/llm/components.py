"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before its shuffle, so a hub costs one row a task) and a
join back, which adaptive execution splits when a hub's links are many. The links are written to
the shared folder after every round, the minima before they are joined: a join of two tables is what
adaptive execution can split. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import release, stash

#: A chain of 2**MAX_ROUNDS links would need more rounds; the loop raises rather than stop early.
MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new links, and the stashed table that they read."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), least


def _small_star(links: DataFrame) -> DataFrame:
    """links: u > v, after a large star: a node has few smaller neighbours left."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of longs → (node, root): each linked node with the least node it reaches.

    Null ends and self-links are ignored; nodes without links don't occur in the result.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, last = None, ()
    for _ in range(MAX_ROUNDS):
        starred, least = _large_star(links)
        links = stash(_small_star(starred), "links")
        release(least, *last)
        last = (links,)
        row = links.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if row == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = row
    raise RuntimeError("components did not settle")
