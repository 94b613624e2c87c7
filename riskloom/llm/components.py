"""Connected components of a link table, by alternating large-star and small-star steps.

Each round is a pair of grouped joins on the links alone; nothing is brought to the driver but
the count of links that changed. Rounds are cut with written tables, so a lost executor costs
one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.staging import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node around: the larger ones in a large star, else the smaller ones."""
    both = links.select("a", "b")
    if large:
        both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long), the smallest reachable node.

    Self-links and repeated links do no harm; nulls must have been removed. Raises if
    ``rounds`` do not suffice.
    """
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where(F.col("a") != F.col("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        links = stage(_star(_star(links, True), False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
