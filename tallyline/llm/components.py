"""Connected components of links, in rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b); only nodes with a link to another one appear.

    Large-star and small-star rounds until the links are stars around the smallest nodes. A round is two aggregations
    and two joins by node; no node's neighbours are gathered anywhere, so a hub is a skewed key at most.
    """
    now = table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(ROUNDS):
        # large star: for each node, its larger neighbours move to its smallest neighbour or itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(now.join(low, "a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        # small star: for each node, its smaller neighbours and itself move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = table(small, "stars")
        # stars around roots: no node has two centres, and no centre is a leaf
        loose = after.groupBy("a").count().where("count > 1").limit(1).count() or after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        now = after
        if not loose:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
