"""A revision store on immutable Parquet files.

Every commit writes a folder of rows and then publishes the next manifest by creating its
file exclusively; a writer that loses the race plans again on the new head.  Readers resolve
one manifest and keep it, so compaction never disturbs them.  Rows carry their creation,
version and previous version, computed once when written: reads need no window, only the
newest row of each key, and watching needs no state.

Manifests go through Hadoop's FileSystem.  A writer first claims a number by creating a file
exclusively, and then puts the manifest in its place by a rename, so no reader sees part of one.
This holds where creation without overwriting and renames are atomic: local file systems and
HDFS, not plain object stores.  A writer that dies between the two leaves its claim, which
`release` takes back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest import errors
from palimpsest.operators import read, txn
from palimpsest.operators.history import in_range
from palimpsest.operators.kv import apply_batch

ROW = "key string, main long, sub long, kind int, value string, prev_main long, prev_sub long, prev_version long, prev_value string, create_main long, create_sub long, version long"
RAW = "key string, value string"
ATTEMPTS = 16


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    head: int = 0
    floor: int = 0
    buckets: dict[str, int] = field(default_factory=dict)
    commits: list[str] = field(default_factory=list)
    raw: dict[str, str] = field(default_factory=dict)
    added: str | None = None  # the commit that this manifest publishes


class Files:
    """The little of Hadoop's FileSystem that a store needs."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path_of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.jvm = jvm

    def names(self, path: str) -> list[str]:
        at = self.path_of(path)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, path: str) -> str:
        stream = self.fs.open(self.path_of(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """False if the file was there already."""
        try:
            stream = self.fs.create(self.path_of(path), False)
        except Exception as e:
            if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def rename(self, path: str, to: str) -> None:
        if not self.fs.rename(self.path_of(path), self.path_of(to)):
            raise OSError(f"{path} can't be renamed to {to}")

    def delete(self, path: str) -> None:
        self.fs.delete(self.path_of(path), False)

    def size(self, path: str) -> int:
        at = self.path_of(path)
        return self.fs.getContentSummary(at).getLength() if self.fs.exists(at) else 0


class Store:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False, must_be_empty: bool = False):
        self.spark, self.path, self.read_only, self.closed = spark, path.rstrip("/"), read_only, False
        self.files = Files(spark, path)
        if not self.files.names(f"{self.path}/manifests"):
            if read_only:
                raise errors.ReadOnly(f"no store at {path}")
            self._publish(Manifest())
        if must_be_empty and self.manifest().head:
            raise errors.NonEmpty(f"{path} is at revision {self.manifest().head}")

    # -- manifests --

    def manifest(self) -> Manifest:
        if self.closed:
            raise errors.Closed(self.path)
        newest = max(n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json"))
        return Manifest(**json.loads(self.files.text(f"{self.path}/manifests/{newest}")))

    def _publish(self, manifest: Manifest) -> bool:
        """False if another writer has the number."""
        name = f"{manifest.number:012d}"
        if not self.files.create(f"{self.path}/claims/{name}", ""):
            return False
        hidden = f"{self.path}/manifests/.{name}-{uuid.uuid4().hex}"
        self.files.create(hidden, json.dumps(asdict(manifest)))
        self.files.rename(hidden, f"{self.path}/manifests/{name}.json")
        return True

    def release(self) -> None:
        """Take back the claim of a writer that died before it published."""
        self.files.delete(f"{self.path}/claims/{self.manifest().number + 1:012d}")

    def _commit(self, plan: Callable[[Manifest], Manifest | None]) -> Manifest:
        """Plan on the newest manifest and publish; plan again if another writer was first."""
        if self.read_only:
            raise errors.ReadOnly(self.path)
        for _ in range(ATTEMPTS):
            now = self.manifest()
            new = plan(replace(now, added=None))
            if new is None:
                return replace(now, added=None)
            if self._publish(replace(new, number=now.number + 1)):
                return replace(new, number=now.number + 1)
        raise errors.CommitConflict(self.path)

    def close(self) -> None:
        self.closed = True

    def size_on_disk(self) -> int:
        m = self.manifest()
        return sum(self.files.size(p) for p in [*m.commits, *m.raw.values()])

    # -- raw buckets --

    def register_bucket(self, name: str, number: int) -> None:
        """The same pair again is fine; the id's conflict is told before the name's."""
        if not 0 <= number <= 65535:
            raise ValueError(f"bucket ids are 0 to 65535, not {number}")

        def plan(m: Manifest) -> Manifest | None:
            owner = next((n for n, i in m.buckets.items() if i == number), name)
            if owner != name:
                raise errors.BucketConflict(f"{number} is {owner!r}")
            if m.buckets.get(name, number) != number:
                raise errors.BucketNameConflict(f"{name!r} is {m.buckets[name]}")
            return None if name in m.buckets else replace(m, buckets={**m.buckets, name: number})

        self._commit(plan)

    def bucket(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        """The bucket's rows as of a manifest (the newest if none)."""
        m = manifest or self.manifest()
        if name not in self.manifest().buckets:
            raise errors.UnknownBucket(name)
        return self.spark.read.schema(RAW).parquet(m.raw[name]) if name in m.raw else self.spark.createDataFrame([], RAW)

    def range(self, bucket: str, start: str, end: str) -> DataFrame:
        if start > end:
            raise errors.InvalidRange(f"{end!r} is before {start!r}")
        return self.bucket(bucket).where((F.col("key") >= start) & (F.col("key") < end)).orderBy("key")

    def commit_group(self, batches: list[dict[str, DataFrame]]) -> Manifest:
        """Apply batches of staged ops (by bucket: op_no, op, key, value) in order, all or nothing."""
        staged: dict[str, DataFrame] = {}
        for number, batch in enumerate(batches):
            for name, ops in batch.items():
                rows = ops.select(F.struct(F.lit(number).alias("batch"), "op_no").alias("op_no"), "op", "key", "value")
                staged[name] = staged[name].unionByName(rows) if name in staged else rows

        def plan(m: Manifest) -> Manifest:
            raw = dict(m.raw)
            for name, ops in staged.items():
                if name not in m.buckets:
                    raise errors.UnknownBucket(name)
                bad = ops.agg(F.count_if(F.length("key") == 0).alias("k"), F.count_if((F.col("op") == "put") & (F.length(F.coalesce("value", F.lit(""))) == 0)).alias("v")).first()
                if bad.k:
                    raise errors.EmptyKey(name)
                if bad.v:
                    raise errors.EmptyValue(name)
                raw[name] = f"{self.path}/raw/{name}/{uuid.uuid4().hex}"
                apply_batch(self.bucket(name, m), ops).repartitionByRange("key").sortWithinPartitions("key").write.parquet(raw[name])
            return replace(m, raw=raw)

        return self._commit(plan)

    # -- revisions --

    def log(self, manifest: Manifest | None = None) -> DataFrame:
        m = manifest or self.manifest()
        return self.spark.read.schema(ROW).parquet(*m.commits) if m.commits else self.spark.createDataFrame([], ROW)

    def _live(self, m: Manifest, revision: int | None = None) -> DataFrame:
        """The newest row of each key, by an aggregate with partial sums; versions are read, not computed."""
        rows = self.log(m) if revision is None else self.log(m).where(F.col("main") <= revision)
        rest = [c for c in rows.columns if c != "key"]
        return rows.groupBy("key").agg(F.max(F.struct(*rest)).alias("r")).select("key", "r.*")

    def range_at(self, start: str, end: str | None = None, revision: int | None = None, limit: int | None = None) -> DataFrame:
        m = self.manifest()
        at = read.check_read(read.Snapshot(m.head, m.floor), start, end, revision)
        rows = self._live(m, at).where(in_range("key", start, end)).where("kind = 0")
        out = rows.select("key", "create_main", "create_sub", F.col("main").alias("mod_main"), F.col("sub").alias("mod_sub"), "version", "value").orderBy("key")
        return out if limit is None else out.limit(limit)

    def range_meta(self, start: str, end: str | None = None, revision: int | None = None, limit: int | None = None) -> tuple[int, bool, int]:
        """count of all matches, more (does the limit cut rows off?), header revision (the head, whatever is read)."""
        m = self.manifest()
        at = read.check_read(read.Snapshot(m.head, m.floor), start, end, revision)
        n = self._live(m, at).where(in_range("key", start, end)).where("kind = 0").count()
        return n, limit is not None and n > limit, m.head

    def _rows(self, m: Manifest, writes: DataFrame, main: int) -> DataFrame:
        """Writes (key, sub, kind, value) with their previous version, creation and version."""
        last = self._live(m).join(writes.select("key").distinct(), "key", "left_semi")
        old = last.select("key", F.struct("kind", F.col("main").alias("m"), F.col("sub").alias("s"), "version", "value", "create_main", "create_sub", "prev_main", "prev_sub", "prev_version", "prev_value").alias("o"))
        w = Window.partitionBy("key").orderBy("sub")
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        g = Window.partitionBy("key", "gen").orderBy("sub")
        rows = writes.join(old, "key", "left").withColumn("gen", F.coalesce(F.sum("kind").over(before), F.lit(0)))
        carried = (F.col("gen") == 0) & F.coalesce(F.col("o.kind") == 0, F.lit(False))
        rows = rows.withColumn("version", F.row_number().over(g) + F.when(carried, F.col("o.version")).otherwise(0))
        rows = rows.withColumn("create_main", F.when(carried, F.col("o.create_main")).otherwise(F.lit(main))).withColumn("create_sub", F.when(carried, F.col("o.create_sub")).otherwise(F.first("sub").over(g)))
        here = F.last(F.when(F.col("kind") == 0, F.struct(F.lit(main).cast("long").alias("m"), F.col("sub").alias("s"), F.col("version").cast("long").alias("v"), F.col("value").alias("t"))), ignorenulls=True).over(before)
        stored = F.when(F.col("o.kind") == 0, F.struct("o.m", "o.s", F.col("o.version").alias("v"), F.col("o.value").alias("t"))).when(
            F.col("o.kind") == 1, F.struct(F.col("o.prev_main").alias("m"), F.col("o.prev_sub").alias("s"), F.col("o.prev_version").alias("v"), F.col("o.prev_value").alias("t"))
        )
        rows = rows.withColumn("p", F.coalesce(here, stored))
        return rows.select(
            "key", F.lit(main).cast("long").alias("main"), F.col("sub").cast("long"), "kind", "value", F.col("p.m").alias("prev_main"), F.col("p.s").alias("prev_sub"), F.col("p.v").alias("prev_version"), F.col("p.t").alias("prev_value"),
            F.col("create_main").cast("long"), F.col("create_sub").cast("long"), F.col("version").cast("long"),
        )

    def _write(self, make: Callable[[Manifest], DataFrame]) -> Manifest:
        """Commit the writes that `make` plans; the manifest that published them, or the head's if there were none."""

        def plan(m: Manifest) -> Manifest | None:
            main, path = m.head + 1, f"{self.path}/log/{uuid.uuid4().hex}"
            self._rows(m, make(m), main).write.parquet(path)
            if self.spark.read.schema(ROW).parquet(path).isEmpty():
                return None
            return replace(m, head=main, commits=[*m.commits, path], added=path)

        return self._commit(plan)

    def put(self, key: str, value: str) -> int:
        if not key:
            raise errors.EmptyKey("put")
        return self._write(lambda m: self.spark.createDataFrame([(key, 0, 0, value)], "key string, sub long, kind int, value string")).head

    def put_all(self, rows: DataFrame) -> int:
        """Put many (key, value) rows, distinct keys, in one commit; subs follow key order inside range partitions."""
        return self._write(lambda m: rows.repartitionByRange("key").sortWithinPartitions("key").select("key", F.monotonically_increasing_id().alias("sub"), F.lit(0).alias("kind"), "value")).head

    def delete_range(self, start: str, end: str | None = None) -> int:
        return self.delete_counted(start, end)[1]

    def delete_counted(self, start: str, end: str | None = None) -> tuple[int, int]:
        """How many keys went, and the revision."""
        m = self._write(lambda m: txn.delete_range(self.log(m), start, end, m.head + 1).select("key", "sub", "kind", "value"))
        return self.spark.read.schema(ROW).parquet(m.added).count() if m.added else 0, m.head

    def txn(self, compares: list[tuple], success: list[tuple], failure: list[tuple]) -> tuple[bool, int]:
        """One conditional transaction.  compares: (key, kind, op, number, value); ops: (op, key, end, value).  (Succeeded, revision)."""
        return self.txn_responses(compares, success, failure)[:2]

    def txn_responses(self, compares: list[tuple], success: list[tuple], failure: list[tuple]) -> tuple[bool, int, list]:
        """As `txn`, with a response for each op of the branch taken: None for a put, how many keys a delete_range deleted first, and the rows of a range at the revision after the writes."""
        outcome: list = []

        def make(m: Manifest) -> DataFrame:
            log = self._live(m)
            probes = self.spark.createDataFrame([(0, i, *c) for i, c in enumerate(compares)], "txn_id long, cmp_no int, key string, target_kind string, op string, target_i64 long, target_value string")
            live = log.where("kind = 0").select("key", F.col("create_main").alias("c"), F.col("main").alias("m"), F.col("version").alias("v"), F.col("value").alias("s"))
            passed = all(r.passed for r in txn.compared(live, probes).collect())  # as many rows as compares
            branch = success if passed else failure
            ops = self.spark.createDataFrame([(0, i, *o) for i, o in enumerate(branch) if o[0] != "range"], "txn_id long, op_no int, op string, key string, end string, value string")
            plan = txn.planned(log.select("key", "main", "sub", "kind", "value"), ops)
            deleted = {r.op_no: r["count"] for r in plan.where("kind = 1").groupBy("op_no").count().collect()} if any(o[0] == "delete_range" for o in branch) else {}  # a row an op
            outcome[:] = [passed, branch, deleted]
            return plan.select("key", "sub", "kind", "value")

        head = self._write(make).head
        passed, branch, deleted = outcome
        answer = lambda i, o: self.range_at(o[1], o[2], head) if o[0] == "range" else deleted.get(i, 0) if o[0] == "delete_range" else None
        return passed, head, [answer(i, o) for i, o in enumerate(branch)]

    def compact(self, revision: int) -> None:
        """Keep of the rows at or below `revision` only those visible then; at or below the floor nothing happens."""

        def plan(m: Manifest) -> Manifest | None:
            if revision <= m.floor:
                return None
            if revision > m.head:
                raise errors.FutureRevision(revision, m.head)
            path = f"{self.path}/log/{uuid.uuid4().hex}"
            base = self._live(m, revision).where("kind = 0").select([c.split()[0] for c in ROW.split(", ")])
            base.unionByName(self.log(m).where(F.col("main") > revision)).repartitionByRange("key").sortWithinPartitions("key", "main", "sub").write.parquet(path)
            return replace(m, floor=revision, commits=[path])

        self._commit(plan)

    def defragment(self) -> None:
        """The same rows in fewer files, clustered by key."""

        def plan(m: Manifest) -> Manifest | None:
            if len(m.commits) < 2:
                return None
            path = f"{self.path}/log/{uuid.uuid4().hex}"
            self.log(m).repartitionByRange("key").sortWithinPartitions("key", "main", "sub").write.parquet(path)
            return replace(m, commits=[path])

        self._commit(plan)

    def events(self, low: int, high: int | None = None) -> DataFrame:
        """Catch-up: the events from `low`, in revision order, each with its previous version."""
        m = self.manifest()
        high = m.head if high is None else high
        if low <= high and m.floor >= low:
            raise errors.Compacted(low, m.floor)
        rows = self.log(m).where(F.col("main").between(low, high))
        return rows.withColumn("value", F.when(F.col("kind") == 1, "").otherwise(F.col("value"))).orderBy("main", "sub")

