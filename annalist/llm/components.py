"""Connected components by alternating large and small stars; nothing about links reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import Scratch


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the smallest node reachable.

    Each round maps every node's larger neighbours, then the smaller ones, to its smallest neighbour. Minima are
    pre-aggregated, so a hub costs no gathered list. Each round's links are written to the shared folder. Self and
    repeated links don't matter; an empty table gives an empty one. More than ``rounds`` rounds raise.
    """
    spark = links.sparkSession
    box = Scratch(spark, "components")
    a, b = F.col("a"), F.col("b")
    now = box.save(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "r0")
    state = None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        large = large.unionByName(now.groupBy("a").agg(F.min("b").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        after = box.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"r{k}")
        told = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        box.drop(f"r{k - 1}")
        now = after
        if tuple(told) == state:
            break
        state = tuple(told)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
