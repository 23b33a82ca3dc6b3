"""Connected components of a distributed graph by alternating stars.

Each round writes its links to the shared folder (lineage stays short, a lost executor costs one
round).  *Large star*: every larger neighbour of a node is linked to the smallest node around it.
*Small star*: every smaller neighbour is.  The links of a component end as one star around its
smallest node; the number of rounds grows with the logarithm of the component size.  Links and
components stay distributed; the driver sees one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pertinax.session import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # every link has a < b: the smaller neighbours of b, and the smallest of them
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x < y")
    return moved.union(least.select(F.col("m"), F.col("b"))).toDF("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (any comparable type, undirected) -> ``node, component`` (its smallest node) for
    every node that has a link to another."""
    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = written(ordered.distinct(), "links")
    state = None
    while True:
        current = written(_small_star(_large_star(current)), "links")
        # the same links twice: nothing moves any more
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    members = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.union(members.select(F.col("component"), F.col("component")).distinct())
