"""Row-ordered operators: fills, sessions, islands, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.stored import stored


def forward_fill(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The latest non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def sessions(df: DataFrame, keys: list[str], order: list, start: Column, name: str = "session") -> DataFrame:
    """How many starts there were up to each row: rows with one number belong together."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(start.cast("long")).over(w))


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Runs of consecutive positions: keys, start, end.

    Rows are range-partitioned by key and position, so that a very common key takes many tasks; runs are found in each
    partition, and those at the partitions' edges (two a partition) are put together."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.select(*keys, position).distinct().repartitionByRange(n, *keys, position).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *keys).orderBy(position)
    runs = dealt.withColumn("_i", F.col(position) - F.row_number().over(within)).groupBy("_part", *keys, "_i").agg(F.min(position).alias("start"), F.max(position).alias("end"))
    place = F.struct(*keys, "start")
    edges = runs.groupBy("_part").agg(F.min(place).alias("_low"), F.max(place).alias("_high"))  # a row a partition
    told = runs.join(edges, "_part").withColumn("_edge", (place == F.col("_low")) | (place == F.col("_high")))
    at_edges = told.where("_edge").select(*keys, "start", "end")
    ahead = Window.partitionBy(*keys).orderBy("start")
    at_edges = at_edges.withColumn("_new", F.coalesce(F.lag("end").over(ahead) + 1 != F.col("start"), F.lit(True)))
    joined = sessions(at_edges, keys, ["start"], F.col("_new"), "_run").groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return told.where("not _edge").select(*keys, "start", "end").union(joined.select(*keys, "start", "end"))


def numbered(df: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Dense numbers 1..n in the given total order, without sending all rows to one task.

    Rows are range-partitioned and sorted; each partition numbers its own rows, and the partitions' sizes (one row
    each) say where it begins.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    before, base = [], first
    for p, size in ordered.groupBy(part.alias("p")).count().orderBy("p").collect():
        before.append((p, base))
        base += size
    starts = spark.createDataFrame(before or [(0, first)], "p long, base long")
    out = ordered.join(F.broadcast(starts), part == F.col("p")).withColumn(name, F.col("base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_id", "p", "base")
