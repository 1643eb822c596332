"""Connected components over an edge table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edge table (a, b), component being the smallest node reachable.

    Large-star and small-star rounds: each round hangs neighbours under the smallest one, and the number of
    rounds grows with the logarithm of the longest path. Minima are pre-aggregated before the shuffle, so a hub
    sends one row a task; the rows of a hub only meet in a join, which Spark splits where it is skewed.
    Nulls in a or b are dropped; an empty table gives an empty result.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, large.a == least.k).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("k", "m").toDF("a", "b"))
        now = cut(small.where("a <> b").distinct())
        before, state = state, _state(now)
        if before == state:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
