"""Watching a key range: catch-up in batch, fan-out to many watchers, and a stream over a store's commits."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palimpsest.errors import Compacted, FutureRevision, InvalidRange
from palimpsest.operators.history import in_range, with_previous
from palimpsest.operators.ranges import matched

#: Events a watcher's buffer holds; one slot more is kept for the closing message.
BUFFER = 1024
#: What the names of watchers' queries begin with.
WATCHER = "palimpsest-watch-"

EVENT = "key string, main long, sub long, kind int, value string, prev_main long, prev_sub long, prev_version long, prev_value string"


def route(start_rev: Column, range_start: Column, range_end: Column, head: int, floor: int) -> Column:
    """What a watch request becomes."""
    return (
        F.when(start_rev < 0, "FutureRevision")
        .when((F.length(range_end) > 0) & (range_end < range_start), "InvalidRange")
        .when((start_rev == 0) | (start_rev > head), "Synced")
        .when(start_rev <= floor, "Compacted")
        .otherwise("Unsynced")
    )


def catch_up(log: DataFrame, low: int, high: int, start: str | None = None, end: str | None = None, floor: int = 0) -> DataFrame:
    """Events from `low` to `high` in revision order, each with the version before it; deletes have an empty value."""
    if low <= high and floor >= low:
        raise Compacted(low, floor)
    rows = log.where(F.col("main") <= high)
    rows = rows if start is None else rows.where(in_range("key", start, end))
    events = with_previous(rows).where(F.col("main") >= low)
    return events.withColumn("value", F.when(F.col("kind") == 1, "").otherwise(F.col("value"))).orderBy("main", "sub")


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events for each watcher whose range holds the key and whose start is reached.

    Keys are matched once each, not once an event: distinct keys and ranges meet by their
    places in one order, and events follow by an equi-join.
    """
    s = subscriptions.select("watcher_id", "range_start", "range_end", "start_rev")
    keys = events.select("key").distinct()
    k = F.col("key")
    asked = s.where("range_end <> ''").select(F.col("range_start").alias("start"), F.col("range_end").alias("end"))
    inside = matched(keys, asked.distinct()).withColumnsRenamed({"start": "range_start", "end": "range_end"})
    held = inside.join(s, ["range_start", "range_end"]).unionByName(keys.join(s.where("range_end = ''"), k == F.col("range_start")))
    return events.join(held.select("key", "watcher_id", "start_rev"), "key").where(F.col("main") >= F.col("start_rev"))


def slow_consumers(delivered: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Per watcher that reads nothing: events taken until its buffer is full, and how it ended."""
    n = delivered.groupBy("watcher_id").agg(F.count("*").alias("n"))
    return n.select("watcher_id", F.least("n", F.lit(buffer)).alias("taken"), F.when(F.col("n") > buffer, "SlowConsumer").otherwise("Open").alias("state"))


def follow(store, handle: Callable[[DataFrame, int], None], checkpoint: str, start: str | None = None, end: str | None = None, start_rev: int = 0, **trigger) -> StreamingQuery:
    """Hand each published commit's events to `handle(events, batch)`, once and in order: first those from `start_rev` on, then live ones.

    What is streamed is the manifests, which are published one by one and whole.  A manifest names
    the commit it added, if it added one, so compaction, defragmentation and commits that lost a
    race deliver nothing.  `start_rev` 0 starts behind the head.  A batch is repeated after a
    failure with the same number and the same commits.
    """
    m = store.manifest()
    if start_rev < 0:
        raise FutureRevision(start_rev, m.head)
    if end and start is not None and end < start:
        raise InvalidRange(f"{end!r} is before {start!r}")
    if 0 < start_rev <= m.floor:
        raise Compacted(start_rev, m.floor)
    low, spark = start_rev or m.head + 1, store.spark
    manifests = spark.readStream.schema("number long, added string").option("wholetext", "true").json(f"{store.path}/manifests")

    def deliver(batch: DataFrame, number: int) -> None:
        paths = [r.added for r in batch.where("added is not null").orderBy("number").collect()]  # a name a commit
        if paths:
            rows = spark.read.schema(EVENT).parquet(*paths).where(F.col("main") >= low)
            rows = rows if start is None else rows.where(in_range("key", start, end))
            handle(rows.withColumn("value", F.when(F.col("kind") == 1, "").otherwise(F.col("value"))).orderBy("main", "sub"), number)

    writer = manifests.writeStream.queryName(f"{WATCHER}{uuid.uuid4().hex}").foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def watchers(spark: SparkSession) -> int:
    """How many watchers follow a store in this application; a stopped one is gone."""
    return sum((q.name or "").startswith(WATCHER) for q in spark.streams.active)


def end_reason(query: StreamingQuery, store) -> str | None:
    """Why a watcher ended, or None while it runs: Cancelled (stopped, or all that was asked for is delivered), StoreDropped, or Internal with the cause."""
    if query.isActive:
        return None
    if not store.files.names(f"{store.path}/manifests"):
        return "StoreDropped"
    cause = query.exception()
    return f"Internal: {cause}" if cause else "Cancelled"


def stream(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, start_rev: int = 0) -> DataFrame:
    """A stream of event files in a folder that only published ones enter (a store's commits: see `follow`); rows carry their previous version, so no state is needed."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 64).option("recursiveFileLookup", "true").parquet(path)
    rows = rows.where(F.col("main") >= start_rev)
    return rows if start is None else rows.where(in_range("key", start, end))
