"""Places in a global order, and keys against ranges, without a nested loop or a task that holds everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.shared import shared_path


def counted(rows: DataFrame, by: list[str], weight: str = "1") -> DataFrame:
    """The rows with `place`: the sum of `weight` over all rows before them in the order of `by`, whose values are distinct.

    Rows are dealt into sorted ranges; each range counts on its own, from the sum of those before
    it, one number a partition.  Ranges are dealt by sampling, so the dealt rows are written to the
    shared folder: both uses, and a task that is run again, must see the same ranges.
    """
    path = shared_path(rows.sparkSession, "ranges")
    rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    sums = dealt.groupBy("part").agg(F.sum(F.expr(weight)).cast("long").alias("n"))
    before = sums.withColumn("begun", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    inside = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(before.drop("n")), "part")
    return placed.withColumn("place", (F.col("begun") + F.coalesce(F.sum(F.expr(weight)).over(inside), F.lit(0))).cast("long")).drop("part", "begun")


def matched(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each range (columns start, end, and others) with each of the distinct keys (column key) in start <= key < end; a null end is open.

    Keys and ends are put in one order; a range is then the keys' places from its start to its
    end, and meets them in an equi-join.  Its work grows with keys, ranges and matches.
    """
    points = keys.select("key", F.lit(1).alias("held"))
    for c in ("start", "end"):
        points = points.union(ranges.select(F.col(c).alias("key"), F.lit(0)).where("key is not null"))
    placed = counted(points.distinct(), ["key", "held"], "held")
    ends = placed.where("held = 0").select("key", "place")
    total = keys.agg(F.count("*").alias("total"))
    found = ranges.join(ends.select(F.col("key").alias("start"), F.col("place").alias("low")), "start")
    found = found.join(ends.select(F.col("key").alias("end"), F.col("place").alias("high")), "end", "left").crossJoin(F.broadcast(total))  # one row
    found = found.withColumn("high", F.coalesce("high", "total")).where("low < high").withColumn("place", F.explode(F.expr("sequence(low, high - 1)")))
    return found.join(placed.where("held = 1").select("key", "place"), "place").select("key", *ranges.columns)
