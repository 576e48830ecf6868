"""Reads: ranges with their metadata, key lookups, walks over a key's revisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import Compacted, FutureRevision, InvalidRange
from palimpsest.operators.history import in_range, latest, visible_at, with_history


@dataclass(frozen=True)
class Snapshot:
    """A head and the compaction floor that belongs to it."""

    rev: int
    compacted: int = 0


def check_read(snapshot: Snapshot, start: str, end: str | None, revision: int | None) -> int:
    """The revision to read at.  Faults in this order: Compacted, FutureRevision, InvalidRange."""
    at = snapshot.rev if revision is None or revision <= 0 else revision
    if at < snapshot.compacted:
        raise Compacted(at, snapshot.compacted)
    if at > snapshot.rev:
        raise FutureRevision(at, snapshot.rev)
    if end and end < start:
        raise InvalidRange(f"{end!r} is before {start!r}")
    return at


def range_(log: DataFrame, start: str | None = None, end: str | None = None, revision: int | None = None, limit: int | None = None, keys_only: bool = False) -> DataFrame:
    """Live keys in key order; `limit` caps the rows (0: none), `keys_only` empties values and never reads them."""
    rows = log if start is None else log.where(in_range("key", start, end))
    if keys_only:
        rows = rows.drop("value")
    out = visible_at(rows, revision)
    out = out.withColumn("value", F.lit("")) if keys_only else out
    out = out.orderBy("key")
    return out if limit is None else out.limit(limit)


def range_meta(log: DataFrame, start: str | None = None, end: str | None = None, revision: int | None = None, limit: int | None = None, count_only: bool = False) -> DataFrame:
    """One row: count of all matches, more (were rows cut off?), header_revision (the head, whatever was read)."""
    rows = log.drop("value") if start is None else log.drop("value").where(in_range("key", start, end))
    matches = latest(rows.withColumn("value", F.lit(None).cast("string")), revision).agg(F.count_if(F.col("kind") == 0).alias("count"))
    head = log.agg(F.max("main").alias("header_revision"))
    more = F.lit(False) if limit is None or count_only else F.col("count") > limit
    return matches.crossJoin(head).select("count", more.alias("more"), "header_revision")  # one row by one row


def key_at(log: DataFrame, keys: DataFrame, revision: int) -> DataFrame:
    """Each asked key's version at `revision`, with status OK, RevisionNotFound (not visible then) or KeyNotFound (never written)."""
    seen = visible_at(log.drop("value"), revision)
    ever = log.groupBy("key").agg(F.lit(True).alias("known"))
    status = F.when(F.col("version").isNotNull(), "OK").when(F.col("known"), "RevisionNotFound").otherwise("KeyNotFound")
    return keys.join(seen, "key", "left").join(ever, "key", "left").select("key", "create_main", "mod_main", "version", status.alias("status"))


def since(log: DataFrame, revision: int) -> DataFrame:
    """For each key its revisions from `revision` on, one per main: the largest sub."""
    return log.where(F.col("main") >= revision).groupBy("key", "main").agg(F.max("sub").alias("sub"))


def events_between(log: DataFrame, low: int, high: int) -> DataFrame:
    """Revisions and kinds from `low` to `high`, both included, in order."""
    return log.where(F.col("main").between(low, high)).select("key", "main", "sub", "kind").orderBy("main", "sub")


def key_stats(log: DataFrame) -> DataFrame:
    """Per key: newest revision, whether it is live, rows, and generations (one more if the last is closed)."""
    return (
        log.groupBy("key")
        .agg(F.max(F.struct("main", "sub", "kind")).alias("m"), F.count("*").alias("rows"), F.sum("kind").cast("long").alias("deletes"))
        .select("key", F.col("m.main").alias("modified_main"), F.col("m.sub").alias("modified_sub"), (F.col("m.kind") == 1).alias("is_empty"), "rows", (F.col("deletes") + 1).alias("generations"))
    )


def restore_status(create: tuple[Column, Column], modified: tuple[Column, Column], version: Column) -> Column:
    """What a restored history row violates first, or OK."""
    return (
        F.when((create[0] < 0) | (modified[0] < 0), "NegativeMain")
        .when((create[1] < 0) | (modified[1] < 0), "NegativeSub")
        .when(F.struct(modified[0].alias("m"), modified[1].alias("s")) < F.struct(create[0].alias("m"), create[1].alias("s")), "ModifiedBeforeCreated")
        .when(version < 1, "VersionLessThanOne")
        .otherwise("OK")
    )


def history(log: DataFrame) -> DataFrame:
    """Every row with its generation, creation and version."""
    return with_history(log)
