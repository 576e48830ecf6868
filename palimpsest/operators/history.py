"""The revision log's window pass: generations, versions, visibility, previous versions.

A log has key, main, sub, kind (0 put, 1 tombstone) and value.  Everything is per key, so
one hash exchange on key serves every column; filters on key reach the scan through the
windows, and filters on main are put below them by these functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVISION = ("main", "sub")


def in_range(key: Column | str, start: str, end: str | None) -> Column:
    """start <= key < end; without an end, key = start."""
    k = F.col(key) if isinstance(key, str) else key
    return (k >= start) & (k < end) if end else k == start


def with_history(log: DataFrame) -> DataFrame:
    """The log with gen, create_main, create_sub, version and next_main of every row."""
    w = Window.partitionBy("key").orderBy(*REVISION)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    g = Window.partitionBy("key", "gen").orderBy(*REVISION)
    return (
        log.withColumn("gen", F.coalesce(F.sum("kind").over(earlier), F.lit(0)).cast("long"))
        .withColumn("next_main", F.lead("main").over(w))
        .withColumn("create_main", F.first("main").over(g))
        .withColumn("create_sub", F.first("sub").over(g))
        .withColumn("version", F.row_number().over(g).cast("long"))
    )


def visible_at(log: DataFrame, revision: int | None = None) -> DataFrame:
    """One row per key alive at `revision` (head if None): key, create_*, mod_*, version, value."""
    rows = log if revision is None else log.where(F.col("main") <= revision)
    revision_ = F.struct(*REVISION)
    deleted = F.max(F.when(F.col("kind") == 1, revision_)).over(Window.partitionBy("key"))
    alive = rows.withColumn("deleted", deleted).where(F.col("deleted").isNull() | (revision_ > F.col("deleted")))
    value = ["value"] if "value" in log.columns else []
    # the same partitioning serves the aggregate: no second exchange
    best = alive.groupBy("key").agg(F.min(revision_).alias("first"), F.max(F.struct(*REVISION, *value)).alias("last"), F.count("*").alias("version"))
    return best.select("key", F.col("first.main").alias("create_main"), F.col("first.sub").alias("create_sub"), F.col("last.main").alias("mod_main"), F.col("last.sub").alias("mod_sub"), "version", *(f"last.{v}" for v in value))


def latest(log: DataFrame, revision: int | None = None) -> DataFrame:
    """The newest row of each key at `revision`, tombstones included; an aggregate with partial sums, no window."""
    rows = log if revision is None else log.where(F.col("main") <= revision)
    best = rows.groupBy("key").agg(F.max(F.struct("main", "sub", "kind", "value")).alias("r"))
    return best.select("key", "r.main", "r.sub", "r.kind", "r.value")


def with_previous(log: DataFrame) -> DataFrame:
    """The log with the live version before each row: prev_main, prev_sub, prev_version, prev_value (tombstones are skipped)."""
    w = Window.partitionBy("key").orderBy(*REVISION).rowsBetween(Window.unboundedPreceding, -1)
    put = F.when(F.col("kind") == 0, F.struct("main", "sub", "version", "value"))
    rows = with_history(log).withColumn("p", F.last(put, ignorenulls=True).over(w))
    return rows.select(*log.columns, F.col("p.main").alias("prev_main"), F.col("p.sub").alias("prev_sub"), F.col("p.version").alias("prev_version"), F.col("p.value").alias("prev_value"))


def applied(log: DataFrame, puts: DataFrame) -> DataFrame:
    """Rows to be put (key, main, sub, kind, value) as they are stored: with creation, version and previous version after the log's rows and each other."""
    both = log.withColumn("new", F.lit(False)).unionByName(puts.withColumn("new", F.lit(True)))
    touched = both.join(puts.select("key").distinct(), "key", "left_semi")
    w = Window.partitionBy("key").orderBy(*REVISION).rowsBetween(Window.unboundedPreceding, -1)
    put = F.when(F.col("kind") == 0, F.struct("main", "sub", "version", "value"))
    rows = with_history(touched).withColumn("p", F.last(put, ignorenulls=True).over(w)).where("new")
    return rows.select(*log.columns, "create_main", "create_sub", "version", F.col("p.main").alias("prev_main"), F.col("p.sub").alias("prev_sub"), F.col("p.version").alias("prev_version"), F.col("p.value").alias("prev_value"))


def batch_as_of(log: DataFrame, probes: DataFrame) -> DataFrame:
    """Each probe (key, at) with the version visible then, or nulls: one pass over the union, no range join."""
    w = Window.partitionBy("key").orderBy("main", "probe", "sub").rowsBetween(Window.unboundedPreceding, -1)
    rows = with_history(log).select("key", "main", "sub", F.lit(0).alias("probe"), F.struct("kind", "main", "sub", "version", "value").alias("row"))
    asked = probes.select("key", F.col("at").alias("main"), F.lit(None).cast("long").alias("sub"), F.lit(1).alias("probe"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    seen = rows.unionByName(asked).withColumn("r", F.last("row", ignorenulls=True).over(w)).where("probe = 1")
    live = lambda c: F.when(F.col("r.kind") == 0, F.col(f"r.{c}"))
    return seen.select("key", F.col("main").alias("at"), live("main").alias("mod_main"), live("sub").alias("mod_sub"), live("version").alias("version"), live("value").alias("value"))


def keep_set(log: DataFrame, revision: int) -> DataFrame:
    """key, main, sub of the rows at or below `revision` that compaction keeps."""
    return visible_at(log.drop("value"), revision).select("key", F.col("mod_main").alias("main"), F.col("mod_sub").alias("sub"))


def compacted(log: DataFrame, revision: int) -> DataFrame:
    """The log after compaction, with create_* and version persisted, which later reads can't recompute."""
    rows = with_history(log)
    old = rows.where((F.col("main") <= revision) & (F.col("kind") == 0) & (F.coalesce("next_main", F.lit(2**63 - 1)) > revision))
    return old.unionByName(rows.where(F.col("main") > revision)).select(*log.columns, "create_main", "create_sub", "version")


def quality(log: DataFrame) -> DataFrame:
    """Rows that no writer would make: a repeated revision, or a tombstone of a dead key; with the fault's name."""
    w = Window.partitionBy("key").orderBy(*REVISION)
    rows = log.withColumn("before", F.lag(F.struct("main", "sub", "kind")).over(w))
    fault = F.when(F.struct("main", "sub") == F.struct("before.main", "before.sub"), "NonMonotonic").when((F.col("kind") == 1) & (F.coalesce("before.kind", F.lit(1)) == 1), "TombstoneOnEmpty")
    return rows.withColumn("fault", fault).where("fault is not null").select("key", "main", "sub", "kind", "fault")
