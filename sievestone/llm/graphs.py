"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, *, rounds: int = 64) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in edges (a, b).

    Alternates two steps until nothing changes. Large star: every node sends its larger neighbours to
    the smallest node it knows; small star: it sends its smaller ones, and itself, there. Both keep the
    components, shrink paths by half or more, and end in stars around the smallest nodes. A hub with
    any number of neighbours costs a grouped minimum, which is combined before the shuffle, and a join
    whose small side has one row per node. No links come to the driver.
    """
    links = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(parent, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = cut(small.unionByName(parent.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        # Stars: no centre is itself a member of another star, and no node has two centres.
        roots = after.select(F.col("b").alias("a")).distinct()
        unsettled = after.join(roots, "a", "left_semi").select("a").unionByName(after.groupBy("a").count().where("count > 1").select("a"))
        done = unsettled.isEmpty()
        links = after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    label = links.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return label.unionByName(links.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id")))
