"""Connected components of a graph that Spark holds as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b), root being the least node reachable.

    Alternates large-star and small-star steps until the edges are stars. Each step is one aggregate
    and one join on the same key; only a count goes to the driver. Raises if ``rounds`` don't suffice.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        pairs = both(now)
        least = pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = pairs.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a != b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        small = cut(small.filter("a != b").distinct())
        heads = small.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
        if not small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() and not heads.limit(1).count():
            break
        now = small
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
