"""The raw key-value layer: batches over a table of (key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import InvalidRange
from palimpsest.operators.ranges import counted


def get(kv: DataFrame, key: str) -> DataFrame:
    return kv.where(F.col("key") == key)


def range_scan(kv: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open, in key order; an empty end is an empty range."""
    return kv.where((F.col("key") >= start) & (F.col("key") < end)).orderBy("key")


def apply_batch(kv: DataFrame, staged: DataFrame) -> DataFrame:
    """The table after staged puts and deletes (op_no, op, key, value): the last op on a key wins."""
    last = staged.groupBy("key").agg(F.max_by(F.struct("op", "value"), "op_no").alias("last"))
    joined = kv.select("key", F.col("value").alias("old")).join(last, "key", "full")
    value = F.when(F.col("last").isNull(), F.col("old")).when(F.col("last.op") == "put", F.col("last.value"))
    return joined.select("key", value.alias("value")).where("value is not null")


def delete_ranges(kv: DataFrame, ranges: DataFrame) -> DataFrame:
    """The table without keys in any [start, end); an empty end is unbounded; an end before its start is an error.

    Ends of ranges are put in order with the keys: +1 at a start and -1 at an end, so a key goes
    where the sum before it is positive.
    """
    if not ranges.where("end <> '' and end < start").isEmpty():
        raise InvalidRange("a range ends before it starts")
    steps = ranges.select(F.col("start").alias("key"), F.lit(1).alias("step")).union(ranges.where("end <> ''").select("end", F.lit(-1)))
    steps = steps.groupBy("key").agg(F.sum("step").cast("long").alias("step")).select("key", F.lit(0).alias("held"), "step")
    placed = counted(steps.union(kv.select("key", F.lit(1), F.lit(0).cast("long")).distinct()), ["key", "held"], "step")
    return kv.join(placed.where("held = 1 and place = 0").select("key"), "key", "left_semi")
