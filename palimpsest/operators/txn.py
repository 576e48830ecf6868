"""Conditional transactions, many at once: compares at one snapshot, a branch each, revisions for its writes.

Probes: txn_id, cmp_no, key, target_kind (version, create, mod, value), op (=, !=, >, <), target_i64, target_value.
Ops: txn_id, branch (success, failure), op_no, op (put, delete_range, range), key, end, value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.history import visible_at
from palimpsest.operators.ranges import counted, matched


def evaluate(log: DataFrame, probes: DataFrame, revision: int | None = None) -> DataFrame:
    """Every probe with `passed`; absent keys count as 0 or as the empty value; nothing is short-circuited."""
    return compared(visible_at(log, revision).select("key", F.col("version").alias("v"), F.col("create_main").alias("c"), F.col("mod_main").alias("m"), F.col("value").alias("s")), probes)


def compared(live: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes with `passed`, against live keys: key, v (version), c (creation), m (modification), s (value)."""
    joined = probes.join(live, "key", "left")
    number = F.coalesce(F.when(F.col("target_kind") == "version", F.col("v")).when(F.col("target_kind") == "create", F.col("c")).otherwise(F.col("m")), F.lit(0))

    def compare(left, right):
        return F.when(F.col("op") == "=", left == right).when(F.col("op") == "!=", left != right).when(F.col("op") == ">", left > right).when(F.col("op") == "<", left < right)

    passed = F.when(F.col("target_kind") == "value", compare(F.coalesce("s", F.lit("")), F.coalesce("target_value", F.lit("")))).otherwise(compare(number, F.col("target_i64")))
    return joined.select(*probes.columns, passed.alias("passed"))


def branches(evaluated: DataFrame, txns: DataFrame) -> DataFrame:
    """txn_id and branch: success if all its compares passed; a transaction without compares succeeds."""
    each = evaluated.groupBy("txn_id").agg(F.every("passed").alias("all"))
    return txns.select("txn_id").distinct().join(each, "txn_id", "left").select("txn_id", F.when(F.coalesce("all", F.lit(True)), "success").otherwise("failure").alias("branch"))


def planned(log: DataFrame, ops: DataFrame, revision: int | None = None) -> DataFrame:
    """The physical writes of each transaction against the keys before it: txn_id, op_no, key, kind, value, sub.

    A delete_range matches keys alive at the snapshot; a key deleted twice is deleted once;
    subs count writes in op and key order.
    """
    live = visible_at(log.drop("value"), revision).select(F.col("key").alias("k"))
    puts = ops.where("op = 'put'").select("txn_id", "op_no", "key", F.lit(0).alias("kind"), "value")
    deletes = ops.where("op = 'delete_range'")
    points = deletes.where("end is null or end = ''").join(live, F.col("key") == F.col("k"))
    asked = deletes.where("end <> ''").select(F.col("key").alias("start"), "end").distinct()
    inside = matched(live.withColumnRenamed("k", "key"), asked).withColumnRenamed("key", "k")
    ranges = deletes.where("end <> ''").withColumnRenamed("key", "start").join(inside, ["start", "end"])
    hit = points.select("txn_id", "op_no", "k").unionByName(ranges.select("txn_id", "op_no", "k")).groupBy("txn_id", "k").agg(F.min("op_no").alias("op_no"))
    gone = hit.select("txn_id", "op_no", F.col("k").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("value"))
    order = Window.partitionBy("txn_id").orderBy("op_no", "key")
    return puts.unionByName(gone).withColumn("sub", (F.row_number().over(order) - 1).cast("long"))


def delete_range(log: DataFrame, start: str, end: str | None, main: int, revision: int | None = None) -> DataFrame:
    """Tombstones for the live keys of a range, one main, subs in key order; none if nothing matches."""
    from palimpsest.operators.history import in_range

    live = visible_at(log.drop("value").where(in_range("key", start, end)), revision)
    # the matches of one call share one main, so their subs are numbered together
    numbered = counted(live.select("key"), ["key"]).select("key", F.lit(main).cast("long").alias("main"), F.col("place").alias("sub"))
    return numbered.select("key", "main", "sub", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("value"))
