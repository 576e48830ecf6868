"""Registry of the queries over the revision log, each with its SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import benchstats, history, kv, raftlog, read, txn
from palimpsest.plans import fixtures as fx
from palimpsest.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

LOW, HIGH = "user/00000003", "user/00000010"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _head(log: DataFrame) -> int:
    """What a store's manifest would say."""
    return log.agg(F.max("main")).first()[0] or 0


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The events log, its head, and a revision at two thirds of it."""
    head = (fx.read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) + 1
    return fx.events_log(spark, sf_dir), head, head * 2 // 3


_HEAD = "head AS (SELECT max(event_id) + 1 AS h, (max(event_id) + 1) * 2 // 3 AS r FROM events)"
_LOG = f"WITH {fx.EVENTS_LOG}, {_HEAD}"
#: For each row its generation, creation and version, by counting earlier rows.
_HISTORY = f"""{_LOG},
g AS (SELECT *, CAST(coalesce(sum(kind) OVER (PARTITION BY key ORDER BY main, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gen,
    lead(main) OVER (PARTITION BY key ORDER BY main, sub) AS next_main FROM log),
hist AS (SELECT *, min(main) OVER (PARTITION BY key, gen) AS create_main, CAST(0 AS BIGINT) AS create_sub,
    CAST(count(*) OVER (PARTITION BY key, gen ORDER BY main, sub) AS BIGINT) AS version FROM g)"""
_KV = "key, create_main, create_sub, main AS mod_main, sub AS mod_sub, version, value"
_AT_R = "kind = 0 AND main <= r AND coalesce(next_main, h + 1) > r"


@query(f"{_HISTORY} SELECT {_KV} FROM hist WHERE kind = 0 AND next_main IS NULL")
def range_head(spark, sf_dir):
    return read.range_(_events(spark, sf_dir)[0])


@query(f"{_HISTORY} SELECT {_KV} FROM hist, head WHERE {_AT_R} AND key >= '{LOW}' AND key < '{HIGH}'")
def range_at_rev(spark, sf_dir):
    log, head, at = _events(spark, sf_dir)
    return read.range_(log, LOW, HIGH, read.check_read(read.Snapshot(head), LOW, HIGH, at))


@query(f"{_HISTORY} SELECT {_KV} FROM hist, head WHERE {_AT_R} AND key = '{LOW}'")
def point_at_rev(spark, sf_dir):
    log, _, at = _events(spark, sf_dir)
    return read.range_(log, LOW, "", at)


@query(f"{_HISTORY} SELECT {_KV} FROM hist WHERE false")
def range_equal_bounds(spark, sf_dir):
    return read.range_(_events(spark, sf_dir)[0], LOW, LOW)


@query(f"{_HISTORY} SELECT {_KV} FROM hist, head WHERE {_AT_R} ORDER BY key LIMIT 5")
def range_limit(spark, sf_dir):
    log, _, at = _events(spark, sf_dir)
    return read.range_(log, revision=at, limit=5)


@query(f"{_HISTORY} SELECT count(*) AS count, count(*) > 5 AS more, max(h) AS header_revision FROM hist, head WHERE {_AT_R}")
def range_meta(spark, sf_dir):
    log, _, at = _events(spark, sf_dir)
    return read.range_meta(log, revision=at, limit=5)


@query(f"{_HISTORY} SELECT key, create_main, create_sub, main AS mod_main, sub AS mod_sub, version, '' AS value FROM hist, head WHERE {_AT_R}")
def range_keys_only(spark, sf_dir):
    log, _, at = _events(spark, sf_dir)
    return read.range_(log, revision=at, keys_only=True)


@query(f"{_HISTORY} SELECT count(*) AS count, false AS more, max(h) AS header_revision FROM hist, head WHERE {_AT_R}")
def range_count(spark, sf_dir):
    log, _, at = _events(spark, sf_dir)
    return read.range_meta(log, revision=at, limit=3, count_only=True)


_ASKED = "asked AS (SELECT 'user/' || lpad(CAST(n_nationkey * 7 AS VARCHAR), 8, '0') AS key FROM nation)"


@query(f"""{_HISTORY}, {_ASKED}, v AS (SELECT * FROM hist, head WHERE {_AT_R})
SELECT a.key, v.create_main, v.main AS mod_main, v.version, CASE WHEN v.key IS NOT NULL THEN 'OK' WHEN a.key IN (SELECT key FROM log) THEN 'RevisionNotFound' ELSE 'KeyNotFound' END AS status
FROM asked a LEFT JOIN v ON v.key = a.key""")
def key_at_rev(spark, sf_dir):
    log, _, at = _events(spark, sf_dir)
    return read.key_at(log, fx.read(spark, sf_dir, "nation").select(fx.user_key(F.col("n_nationkey") * 7).alias("key")), at)


@query(f"WITH {fx.LINEITEM_LOG} SELECT key, main, max(sub) AS sub FROM log WHERE main >= 500 GROUP BY key, main")
def since(spark, sf_dir):
    return read.since(fx.lineitem_log(spark, sf_dir), 500)


@query(f"WITH {fx.EVENTS_LOG} SELECT key, main, sub, kind FROM log WHERE main >= 100 AND main <= 300")
def events_in_range(spark, sf_dir):
    return read.events_between(fx.events_log(spark, sf_dir), 100, 300)


@query(f"""WITH {fx.EVENTS_LOG} SELECT key, max(main) AS modified_main, CAST(0 AS BIGINT) AS modified_sub, arg_max(kind, main) = 1 AS is_empty, count(*) AS rows,
CAST(count(*) FILTER (kind = 1) + 1 AS BIGINT) AS generations FROM log GROUP BY key""")
def key_stats(spark, sf_dir):
    return read.key_stats(fx.events_log(spark, sf_dir))


@query(f"WITH {fx.EVENTS_LOG} SELECT max(main) AS head, count(DISTINCT key) AS keys FROM log")
def head_revision(spark, sf_dir):
    return fx.events_log(spark, sf_dir).agg(F.max("main").alias("head"), F.countDistinct("key").alias("keys"))


@query(f"WITH {fx.LINEITEM_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY main DESC, sub DESC) AS i FROM log WHERE main <= (SELECT (max(l_orderkey) + 1) * 2 // 3 FROM lineitem)) SELECT key, main, sub, kind, value FROM n WHERE i = 1")
def latest_per_key(spark, sf_dir):
    head = (fx.read(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0) + 1
    return history.latest(fx.lineitem_log(spark, sf_dir), head * 2 // 3)


@query(f"""{_HISTORY}, {_ASKED}, p AS (SELECT key, k * h // 5 AS at FROM asked, head, (SELECT unnest([1, 2, 3, 4]) AS k))
SELECT p.key, p.at, v.main AS mod_main, v.sub AS mod_sub, v.version, v.value FROM p LEFT JOIN hist v ON v.key = p.key AND v.kind = 0 AND v.main <= p.at AND (v.next_main IS NULL OR v.next_main > p.at)""")
def batch_as_of(spark, sf_dir):
    log, head, _ = _events(spark, sf_dir)
    keys = fx.read(spark, sf_dir, "nation").select(fx.user_key(F.col("n_nationkey") * 7).alias("key"))
    return history.batch_as_of(log, keys.withColumn("at", F.explode(F.array(*(F.lit(k * head // 5).cast("long") for k in (1, 2, 3, 4))))))


_PREV = f"""{_HISTORY}, prev AS (SELECT a.*, b.main AS prev_main, b.sub AS prev_sub, b.version AS prev_version, b.value AS prev_value
    FROM (SELECT *, max(CASE WHEN kind = 0 THEN main END) OVER (PARTITION BY key ORDER BY main ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM hist) a
    LEFT JOIN hist b ON b.key = a.key AND b.main = a.pm)"""
_EVENT = "key, main, sub, kind, CASE WHEN kind = 1 THEN '' ELSE value END AS value, prev_main, prev_sub, prev_version, prev_value"


@query(f"{_PREV} SELECT key, main, sub, prev_main, prev_sub, prev_version FROM prev")
def prev_kv(spark, sf_dir):
    return history.with_previous(fx.events_log(spark, sf_dir)).select("key", "main", "sub", "prev_main", "prev_sub", "prev_version")


@query(f"{_PREV} SELECT {_EVENT} FROM prev")
def cdc_with_prev(spark, sf_dir):
    log, head, _ = _events(spark, sf_dir)
    return watch.catch_up(log, 1, head)


@query(f"{_HISTORY} SELECT key, main, sub, kind, gen, create_main, create_sub, version, next_main FROM hist")
def history_full(spark, sf_dir):
    return read.history(fx.events_log(spark, sf_dir).drop("value")).select("key", "main", "sub", "kind", "gen", "create_main", "create_sub", "version", "next_main")


@query(f"""{_HISTORY}, puts AS (SELECT 'user/' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key, h + c_custkey AS main, c_mktsegment AS value FROM customer, head),
before AS (SELECT key, max(main) AS main FROM hist WHERE kind = 0 GROUP BY key)
SELECT p.key, p.main, CAST(0 AS BIGINT) AS sub, 0 AS kind, p.value, coalesce(l.create_main, p.main) AS create_main, CAST(0 AS BIGINT) AS create_sub, coalesce(l.version, 0) + 1 AS version,
    b.main AS prev_main, b.sub AS prev_sub, b.version AS prev_version, b.value AS prev_value
FROM puts p LEFT JOIN hist l ON l.key = p.key AND l.kind = 0 AND l.next_main IS NULL LEFT JOIN before m ON m.key = p.key LEFT JOIN hist b ON b.key = m.key AND b.main = m.main""")
def mvcc_apply_puts(spark, sf_dir):
    log, head, _ = _events(spark, sf_dir)
    puts = fx.read(spark, sf_dir, "customer").select(fx.user_key(F.col("c_custkey")).alias("key"), (F.col("c_custkey") + head).alias("main"), F.lit(0).cast("long").alias("sub"), F.lit(0).alias("kind"), F.col("c_mktsegment").alias("value"))
    return history.applied(log, puts)


@query(f"""{_HISTORY} SELECT key, h + 1 AS main, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS sub, 1 AS kind, CAST(NULL AS VARCHAR) AS value
FROM hist, head WHERE kind = 0 AND next_main IS NULL AND key >= '{LOW}' AND key < '{HIGH}'""")
def mvcc_delete_range(spark, sf_dir):
    log, head, _ = _events(spark, sf_dir)
    return txn.delete_range(log, LOW, HIGH, head + 1)


_LIVE = "live AS (SELECT key, create_main, main, version, value FROM hist WHERE kind = 0 AND next_main IS NULL)"
_EVALUATED = f"""{_HISTORY}, {_LIVE}, {fx.COMPARES},
j AS (SELECT p.*, CASE target_kind WHEN 'version' THEN coalesce(version, 0) WHEN 'create' THEN coalesce(create_main, 0) ELSE coalesce(main, 0) END AS n, coalesce(value, '') AS s FROM probes p LEFT JOIN live USING (key)),
evaluated AS (SELECT txn_id, cmp_no, key, target_kind, op, target_i64, target_value,
    CASE WHEN target_kind = 'value' THEN CASE op WHEN '=' THEN s = target_value WHEN '!=' THEN s <> target_value WHEN '>' THEN s > target_value ELSE s < target_value END
         ELSE CASE op WHEN '=' THEN n = target_i64 WHEN '!=' THEN n <> target_i64 WHEN '>' THEN n > target_i64 ELSE n < target_i64 END END AS passed FROM j)"""


@query(f"{_EVALUATED} SELECT * FROM evaluated")
def compare_eval(spark, sf_dir):
    return txn.evaluate(fx.events_log(spark, sf_dir), fx.compares(spark, sf_dir))


@query(f"{_EVALUATED} SELECT txn_id, bool_and(passed) AS passed FROM evaluated GROUP BY txn_id")
def compare_all(spark, sf_dir):
    return txn.evaluate(fx.events_log(spark, sf_dir), fx.compares(spark, sf_dir)).groupBy("txn_id").agg(F.every("passed").alias("passed"))


@query(f"{_EVALUATED} SELECT o.txn_id, CASE WHEN coalesce(bool_and(passed), true) THEN 'success' ELSE 'failure' END AS branch FROM (SELECT DISTINCT o_orderkey AS txn_id FROM orders) o LEFT JOIN evaluated e ON e.txn_id = o.txn_id GROUP BY o.txn_id")
def txn_compare_branch(spark, sf_dir):
    done = txn.evaluate(fx.events_log(spark, sf_dir), fx.compares(spark, sf_dir))
    return txn.branches(done, fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("txn_id")))


_PLAN = f"""{_HISTORY}, {_LIVE}, {fx.TXN_OPS},
w AS (SELECT txn_id, op_no, key, 0 AS kind, value FROM ops WHERE op = 'put'
    UNION ALL SELECT txn_id, min(op_no), live.key, 1, NULL FROM ops JOIN live ON live.key >= ops.key AND live.key < ops."end" WHERE op = 'delete_range' GROUP BY txn_id, live.key),
plan AS (SELECT *, CAST(row_number() OVER (PARTITION BY txn_id ORDER BY op_no, key) - 1 AS BIGINT) AS sub FROM w)"""


@query(f"{_PLAN} SELECT txn_id, op_no, key, kind, value, sub FROM plan")
def txn_subs(spark, sf_dir):
    return txn.planned(fx.events_log(spark, sf_dir), fx.txn_ops(spark, sf_dir))


@query(f"""{_PLAN}, t AS (SELECT min(txn_id) AS id FROM plan),
after AS (SELECT key, value, main, version FROM live WHERE key NOT IN (SELECT key FROM plan, t WHERE txn_id = id) UNION ALL SELECT key, value, h + 1, 1 FROM plan, t, head WHERE txn_id = id AND kind = 0)
SELECT key, main AS mod_main, version, value FROM after""")
def txn_range_post_commit(spark, sf_dir):
    log, head, _ = _events(spark, sf_dir)
    ops = fx.txn_ops(spark, sf_dir)
    first = ops.agg(F.min("txn_id")).first()[0]
    plan = txn.planned(log, ops.where(F.col("txn_id") == first))
    after = log.unionByName(plan.select("key", F.lit(head + 1).cast("long").alias("main"), "sub", "kind", "value"))
    return history.visible_at(after).select("key", "mod_main", "version", "value")


@query(f"{_HISTORY} SELECT key, main, sub FROM hist, head WHERE {_AT_R}")
def mvcc_keep_set(spark, sf_dir):
    log, _, at = _events(spark, sf_dir)
    return history.keep_set(log, at)


@query(f"{_HISTORY} SELECT key, main, sub, kind, value, create_main, create_sub, version FROM hist, head WHERE main > r OR ({_AT_R})")
def mvcc_compact(spark, sf_dir):
    log, _, at = _events(spark, sf_dir)
    return history.compacted(log, at)


@query(f"{_HISTORY} SELECT {_KV} FROM hist WHERE kind = 0 AND next_main IS NULL")
def range_after_compact(spark, sf_dir):
    log, _, at = _events(spark, sf_dir)
    kept = history.compacted(log, at)
    last = kept.groupBy("key").agg(F.max(F.struct("main", "sub", "kind", "value", "create_main", "create_sub", "version")).alias("r")).where("r.kind = 0")
    return last.select("key", "r.create_main", "r.create_sub", F.col("r.main").alias("mod_main"), F.col("r.sub").alias("mod_sub"), "r.version", "r.value")


@query(f"WITH {fx.EVENTS_LOG} SELECT key, main, sub + kind AS sub, kind, CASE kind WHEN 0 THEN 'NonMonotonic' ELSE 'TombstoneOnEmpty' END AS fault FROM log")
def log_quality(spark, sf_dir):
    """A log with every put written twice, and a second tombstone behind every tombstone."""
    log = fx.events_log(spark, sf_dir)
    return history.quality(log.unionByName(log.withColumn("sub", F.col("sub") + F.col("kind"))))


@query("""WITH r AS (SELECT event_id AS id, event_id % 7 - 1 AS cm, event_id % 5 AS cs, event_id % 9 - 1 AS mm, event_id % 3 AS ms, event_id % 4 AS v FROM events)
SELECT id, CASE WHEN cm < 0 OR mm < 0 THEN 'NegativeMain' WHEN cs < 0 OR ms < 0 THEN 'NegativeSub' WHEN mm < cm OR (mm = cm AND ms < cs) THEN 'ModifiedBeforeCreated' WHEN v < 1 THEN 'VersionLessThanOne' ELSE 'OK' END AS status FROM r""")
def restore_validate(spark, sf_dir):
    i = F.col("event_id")
    status = read.restore_status((i % 7 - 1, i % 5), (i % 9 - 1, i % 3), i % 4)
    return fx.read(spark, sf_dir, "events").select(i.alias("id"), status.alias("status"))


@query(f"{_PREV} SELECT {_EVENT} FROM prev, head WHERE main >= r AND key >= '{LOW}' AND key < '{HIGH}'")
def watch_catchup(spark, sf_dir):
    log, head, at = _events(spark, sf_dir)
    return watch.catch_up(log, at, head, LOW, HIGH)


_FANNED = f"""{_LOG}, {fx.SUBSCRIPTIONS}, fanned AS (SELECT watcher_id, key, main, sub, kind FROM subs JOIN log ON key >= range_start AND key < range_end AND main >= start_rev)"""


@query(f"{_FANNED} SELECT * FROM fanned")
def watch_fanout(spark, sf_dir):
    return watch.fan_out(fx.events_log(spark, sf_dir), fx.subscriptions(spark, sf_dir)).select("watcher_id", "key", "main", "sub", "kind")


@query(f"{_FANNED} SELECT watcher_id, least(count(*), 1024) AS taken, CASE WHEN count(*) > 1024 THEN 'SlowConsumer' ELSE 'Open' END AS state FROM fanned GROUP BY watcher_id")
def watch_slow_consumer(spark, sf_dir):
    return watch.slow_consumers(watch.fan_out(fx.events_log(spark, sf_dir), fx.subscriptions(spark, sf_dir)))


@query("""WITH q AS (SELECT event_id AS id, event_id % 700 - 50 AS rev, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'b' ELSE 'x' END AS re FROM events)
SELECT id, CASE WHEN rev < 0 THEN 'FutureRevision' WHEN re <> '' AND re < 'm' THEN 'InvalidRange' WHEN rev = 0 OR rev > 600 THEN 'Synced' WHEN rev <= 200 THEN 'Compacted' ELSE 'Unsynced' END AS route FROM q""")
def watch_route(spark, sf_dir):
    i = F.col("event_id")
    end = F.when(i % 3 == 0, "").when(i % 3 == 1, "b").otherwise("x")
    return fx.read(spark, sf_dir, "events").select(i.alias("id"), watch.route(i % 700 - 50, F.lit("m"), end, 600, 200).alias("route"))


@query(f"{_PREV} SELECT {_EVENT} FROM prev")
def watch_stream(spark, sf_dir):
    """Catch-up events written as a store writes commits, then read to the end by a stream."""
    from palimpsest.sources.shared import shared_path

    log, head, _ = _events(spark, sf_dir)
    path, out, state = (shared_path(spark, x) for x in ("commits", "delivered", "state"))
    watch.catch_up(log, 1, head).write.parquet(path)
    run = watch.stream(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(watch.EVENT).parquet(out)


@query(f"WITH {fx.DOCUMENTS_KV} SELECT key, value FROM kv WHERE key = 'src1/en/00000000' OR key = (SELECT min(key) FROM kv)")
def kv_get(spark, sf_dir):
    table = fx.documents_kv(spark, sf_dir)
    least = table.agg(F.min("key")).first()[0]
    return kv.get(table, least).unionByName(kv.get(table, "src1/en/00000000")).distinct()


@query(f"WITH {fx.DOCUMENTS_KV} SELECT key, value FROM kv WHERE key >= 'src1/' AND key < 'src2/'")
def kv_range_scan(spark, sf_dir):
    return kv.range_scan(fx.documents_kv(spark, sf_dir), "src1/", "src2/")


_STAGED = """staged AS (SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS key, doc_id AS op_no, CASE WHEN doc_id % 4 = 0 THEN 'delete' ELSE 'put' END AS op, 'new' AS value FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT 'zzz/' || CAST(doc_id % 10 AS VARCHAR), doc_id, CASE WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'put' END, CAST(doc_id AS VARCHAR) FROM documents)"""


@query(f"""WITH {fx.DOCUMENTS_KV}, {_STAGED}, l AS (SELECT key, arg_max(op, op_no) AS op, arg_max(value, op_no) AS value FROM staged GROUP BY key)
SELECT coalesce(kv.key, l.key) AS key, CASE WHEN l.key IS NULL THEN kv.value ELSE l.value END AS value FROM kv FULL JOIN l ON kv.key = l.key WHERE l.key IS NULL OR l.op = 'put'""")
def kv_batch_apply(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents")
    key = F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    own = d.where("doc_id % 2 = 0").select(key.alias("key"), F.col("doc_id").alias("op_no"), F.when(F.col("doc_id") % 4 == 0, "delete").otherwise("put").alias("op"), F.lit("new").alias("value"))
    new = d.select(F.concat(F.lit("zzz/"), (F.col("doc_id") % 10).cast("string")).alias("key"), F.col("doc_id").alias("op_no"), F.when(F.col("doc_id") % 3 == 0, "delete").otherwise("put").alias("op"), F.col("doc_id").cast("string").alias("value"))
    return kv.apply_batch(fx.documents_kv(spark, sf_dir), own.unionByName(new))


@query(f"WITH {fx.DOCUMENTS_KV} SELECT key, value FROM kv WHERE NOT (key >= 'src1' AND key < 'src2') AND NOT (key >= 'src15' AND key < 'src3') AND NOT key >= 'src8'")
def kv_delete_range_raw(spark, sf_dir):
    ranges = spark.createDataFrame([("src1", "src2"), ("src15", "src3"), ("src8", "")], "start string, end string")
    return kv.delete_ranges(fx.documents_kv(spark, sf_dir), ranges)


_HEX = "lpad(printf('%X', main), 16, '0') || '5F' || lpad(printf('%X', sub), 16, '0') || CASE WHEN kind = 1 THEN '74' ELSE '' END"


@query(f"WITH {fx.EVENTS_LOG} SELECT main, sub, kind, {_HEX} AS encoded, CAST(main AS VARCHAR) || '_' || CAST(sub AS VARCHAR) AS shown FROM log")
def encode_revision(spark, sf_dir):
    return fx.events_log(spark, sf_dir).select("main", "sub", "kind", F.hex(codec.encode("main", "sub", "kind")).alias("encoded"), codec.display("main", "sub").alias("shown"))


@query(f"""WITH {fx.EVENTS_LOG} SELECT main AS id, CASE main % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'BadLength' WHEN 2 THEN 'BadSeparator' WHEN 3 THEN 'NegativeRevision' ELSE 'UnknownMark' END AS status,
CASE WHEN main % 5 = 0 THEN main END AS main, CASE WHEN main % 5 = 0 THEN sub END AS sub, CASE WHEN main % 5 = 0 THEN kind END AS kind FROM log""")
def decode_revision(spark, sf_dir):
    good, plain = codec.encode("main", "sub", "kind"), codec.encode("main", "sub", F.lit(0))
    negative = F.concat(F.lit(b"\xff"), F.substring(plain, 2, 16))
    key = F.when(F.col("main") % 5 == 0, good).when(F.col("main") % 5 == 1, F.substring(plain, 1, 9)).when(F.col("main") % 5 == 2, F.concat(F.substring(plain, 1, 8), F.lit(b"-"), F.substring(plain, 10, 8)))
    key = key.when(F.col("main") % 5 == 3, negative).otherwise(F.concat(plain, F.lit(b"x")))
    rows = fx.events_log(spark, sf_dir).select(F.col("main").alias("id"), key.alias("k"))
    return rows.select("id", codec.decode_status("k").alias("status"), codec.decode_main("k").alias("main"), codec.decode_sub("k").alias("sub"), codec.decode_kind("k").alias("kind"))


@query(f"WITH {fx.LINEITEM_LOG} SELECT count(*) AS compared, CAST(0 AS BIGINT) AS out_of_order FROM (SELECT lag(main) OVER (PARTITION BY key ORDER BY main, sub) AS before FROM log) WHERE before IS NOT NULL")
def codec_order(spark, sf_dir):
    from pyspark.sql import Window

    code = codec.encode("main", "sub", "kind")
    rows = fx.lineitem_log(spark, sf_dir).select(code.alias("code"), F.lag(code).over(Window.partitionBy("key").orderBy("main", "sub")).alias("before")).where("before is not null")
    return rows.agg(F.count("*").alias("compared"), F.count_if(F.col("code") <= F.col("before")).alias("out_of_order"))


@query()
def shard_skew(spark, sf_dir):
    keys = fx.events_log(spark, sf_dir).select("key").distinct()
    return keys.groupBy(codec.shard("key").alias("shard")).agg(F.count("*").alias("keys"))


@query(f"""WITH {fx.RAFT_ENTRIES} SELECT "index", coalesce(lag("index") OVER (ORDER BY "index"), 0) + 1 AS expected FROM entries QUALIFY "index" <> coalesce(lag("index") OVER (ORDER BY "index"), 0) + 1""")
def raft_gap_check(spark, sf_dir):
    return raftlog.gaps(fx.raft_entries(spark, sf_dir))


@query(f"""WITH {fx.RAFT_ENTRIES} SELECT "index", term, CASE entry_type WHEN 'ConfChangeV2' THEN 'ConfChange' ELSE entry_type END AS entry_type, data FROM entries WHERE "index" BETWEEN 100 AND 299""")
def raft_entries(spark, sf_dir):
    return raftlog.entries_between(fx.raft_entries(spark, sf_dir), 100, 300).withColumn("entry_type", raftlog.folded_type(F.col("entry_type")))


@query(f"""WITH {fx.RAFT_ENTRIES} SELECT min("index") AS first_index, max("index") AS last_index FROM entries WHERE "index" >= 500""")
def raft_bounds(spark, sf_dir):
    return raftlog.bounds(raftlog.compact(fx.raft_entries(spark, sf_dir), 500))


@query(f"WITH {fx.LINEITEM_LOG} SELECT count(*) AS n, bit_xor(CAST(ascii(key) AS BIGINT) + CAST(ascii(value) AS BIGINT) * 256) AS checksum FROM log")
def range_checksum(spark, sf_dir):
    return benchstats.checksum(fx.lineitem_log(spark, sf_dir))


@query("""WITH x AS (SELECT event_type, greatest(least(value, 60000000.0), 1.0) AS x FROM events)
SELECT event_type, count(*) AS n, min(x) AS least, max(x) AS most, avg(x) AS mean, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90, quantile_cont(x, 0.99) AS p99 FROM x GROUP BY event_type""")
def latency_quantiles(spark, sf_dir):
    out = benchstats.latency_quantiles(fx.read(spark, sf_dir, "events"), "event_type", "value")
    return out


_VERDICTS = """m AS (SELECT o_orderpriority AS metric, min(o_totalprice) / 1000 AS low, max(o_totalprice) / 100000 AS high, count(*) AS n FROM orders GROUP BY o_orderpriority),
v AS (SELECT metric, low, high, CASE WHEN low >= 1.05 THEN 'Win' WHEN high <= 0.95 THEN 'Loss' ELSE 'Tie' END AS verdict FROM m)"""


def _verdicts(spark, sf_dir):
    o = fx.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg((F.min("o_totalprice") / 1000).alias("low"), (F.max("o_totalprice") / 100000).alias("high"))
    return o.withColumn("verdict", benchstats.verdict(F.col("low"), F.col("high")))


@query(f"WITH {_VERDICTS} SELECT metric, low, high, verdict FROM v")
def gate_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir)


@query(f"""WITH {_VERDICTS} SELECT count(*) FILTER (verdict = 'Win') AS wins, count(*) FILTER (verdict = 'Loss') AS losses, count(*) FILTER (verdict = 'Tie') AS ties, count(*) FILTER (verdict IS NULL) AS incomplete,
count(*) FILTER (verdict = 'Win') >= 1 AND count(*) FILTER (verdict = 'Loss') = 0 AND count(*) FILTER (verdict IS NULL) = 0 AS passed FROM v""")
def gate_report(spark, sf_dir):
    return benchstats.gate(_verdicts(spark, sf_dir))


@query()
def zipf_sample(spark, sf_dir):
    return benchstats.zipf_samples(spark, 50_000, 1_000_000).groupBy("item").count()


@query()
def bootstrap_ci(spark, sf_dir):
    return benchstats.bootstrap(fx.bench_runs(spark, sf_dir))
