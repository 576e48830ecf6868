"""The replicated log's table: index, term, entry_type, data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.errors import InvalidRange


def gaps(entries: DataFrame, last_index: int = 0) -> DataFrame:
    """Entries that don't follow their predecessor directly: term, index, expected.

    Checked inside blocks of indexes and, by the entry before each block, between them.
    """
    before = Window.partitionBy("block").orderBy("index")
    blocks = entries.withColumn("block", F.floor(F.col("index") / 4096))
    edge = blocks.groupBy("block").agg(F.max("index").alias("top")).withColumn("before", F.coalesce(F.lag("top").over(Window.orderBy("block")), F.lit(last_index)))  # a row a block
    inside = blocks.withColumn("last", F.lag("index").over(before)).join(edge.select("block", "before"), "block")
    expected = F.coalesce("last", "before") + 1
    return inside.select("index", expected.alias("expected")).where(F.col("index") != F.col("expected"))


def entries_between(entries: DataFrame, low: int, high: int) -> DataFrame:
    """Half-open; low after high, and indexes that the log doesn't have, are errors."""
    if low > high:
        raise InvalidRange(f"{low} is after {high}")
    at = bounds(entries).first()
    if low < high and (low < at.first_index or high > at.last_index + 1):
        raise InvalidRange(f"[{low}, {high}) is not inside [{at.first_index}, {at.last_index + 1})")
    return entries.where((F.col("index") >= low) & (F.col("index") < high)).orderBy("index")


def append(entries: DataFrame, more: DataFrame, last_index: int = 0) -> DataFrame:
    """The log after consecutive entries: they follow the last one (`last_index` of an empty log), or replace its end from their first index on."""
    new, old = more.agg(F.min("index"), F.max("index"), F.count("*")).first(), bounds(entries, last_index).first()
    if not new[2]:
        return entries
    if new[1] - new[0] + 1 != new[2] or more.select("index").distinct().count() != new[2]:
        raise InvalidRange("appended entries are not consecutive")
    if new[0] > old.last_index + 1 or new[0] <= last_index:
        raise InvalidRange(f"{new[0]} doesn't follow {old.last_index}")
    return entries.where(F.col("index") < new[0]).unionByName(more.select(entries.columns))


def hard_state(states: DataFrame) -> DataFrame:
    """The newest term, vote and commit of a table of saved states (seq, term, vote, commit); zeros if none was saved."""
    last = states.agg(F.max(F.struct("seq", "term", "vote", "commit")).alias("s"))
    return last.select(*(F.coalesce(f"s.{c}", F.lit(0)).cast("long").alias(c) for c in ("term", "vote", "commit")))


def bounds(entries: DataFrame, snapshot_index: int = 0) -> DataFrame:
    """first_index and last_index; an empty log answers from its snapshot, or 0."""
    first = F.coalesce(F.min("index"), F.lit(snapshot_index + 1 if snapshot_index else 0))
    return entries.agg(first.cast("long").alias("first_index"), F.greatest(F.coalesce(F.max("index"), F.lit(0)), F.lit(snapshot_index)).cast("long").alias("last_index"))


def compact(entries: DataFrame, index: int) -> DataFrame:
    return entries.where(F.col("index") >= index)


def install_snapshot(entries: DataFrame, cursor: int, index: int) -> tuple[DataFrame, int]:
    """The entries after the snapshot, and the cursor, which only moves forward."""
    cursor = max(cursor, index)
    return compact(entries, cursor + 1), cursor


def folded_type(entry_type: Column) -> Column:
    return F.when(entry_type == "ConfChangeV2", "ConfChange").otherwise(entry_type)
