"""Connected components of a table of links, by alternating large-star and small-star steps.

Nothing but counts reaches the driver. Each step writes its links to the shared folder, so a lost executor costs
one step. Steps grow with the logarithm of the longest path. The hub of a star is aggregated before the shuffle, and
its links get their new end from a broadcast of the few hubs, so no task sees all links of one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle

MOST_STEPS = 60


def _star(links: DataFrame, both: bool, total: int) -> DataFrame:
    """Link each node's neighbours (larger ones, or with itself the smaller ones) to the least of them. total: links there are."""
    sides = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        sides = sides.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    if both:
        least = least.withColumn("m", F.least("u", "m"))
        out = lookup(sides.filter("v > u"), least, ["u"], "degree", 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = lookup(sides, least, ["u"], "degree", total).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(links: DataFrame) -> tuple[int, bool]:
    """How many links there are, and whether they are stars: no node has two smaller ends, or a smaller and a larger one."""
    ends = links.select(F.col("a").alias("n"), F.lit(1).alias("smaller"), F.lit(0).alias("larger"))
    ends = ends.unionByName(links.select(F.col("b").alias("n"), F.lit(0).alias("smaller"), F.lit(1).alias("larger")))
    nodes = ends.groupBy("n").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    row = nodes.agg(F.sum("smaller"), F.count(F.when(F.col("smaller") + F.col("larger") * F.signum("smaller") > 1, 1))).first()
    return row[0] or 0, not row[1]


def components(links: DataFrame) -> DataFrame:
    """links (a, b), two orderable ids, in any order -> (node, root): the least id that each linked node reaches.

    No links give no rows. Links of a node with itself and repeated links change nothing; nodes that have only
    such links give no row.
    """
    links = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    total, stars = _state(links)
    for _ in range(MOST_STEPS):
        if stars:
            break
        wide = settle(_star(links, True, total), "links")  # as many links as before at most
        links = settle(_star(wide, False, total), "links")
        total, stars = _state(links)
    else:
        raise RuntimeError(f"no end after {MOST_STEPS} steps")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
