"""Revision logs, key-value tables and requests derived from the driver's tables.

Each derivation has its Spark form and its SQL; names match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one single-write commit per event; errors delete the user's key, if it is live."""
    e = read(spark, sf_dir, "events")
    raw = e.select(
        F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"), (F.col("event_id") + 1).alias("main"), F.lit(0).cast("long").alias("sub"),
        (F.col("event_type") == "error").cast("int").alias("kind"), F.concat("event_type", F.lit(":"), "props").alias("value"),
    )
    before = F.lag("kind").over(Window.partitionBy("key").orderBy("main"))
    kept = raw.withColumn("before", before).where((F.col("kind") == 0) | (F.col("before") == 0))
    return kept.select("key", "main", "sub", "kind", F.when(F.col("kind") == 0, F.col("value")).alias("value"))


EVENTS_LOG = """raw AS (SELECT 'user/' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id + 1 AS main, CAST(0 AS BIGINT) AS sub,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind, event_type || ':' || props AS value FROM events),
log AS (SELECT key, main, sub, kind, CASE WHEN kind = 0 THEN value END AS value
    FROM (SELECT *, lag(kind) OVER (PARTITION BY key ORDER BY main) AS before FROM raw) WHERE kind = 0 OR before = 0)"""


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one transaction per order, a put per line; subs follow a total order of the line's columns."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    order = Window.partitionBy("l_orderkey").orderBy(*[c for c in l.columns if c != "l_orderkey"])
    return l.select(
        F.concat(F.lit("part/"), F.lpad(F.col("l_partkey").cast("string"), 8, "0")).alias("key"), (F.col("l_orderkey") + 1).alias("main"),
        (F.row_number().over(order) - 1).cast("long").alias("sub"), F.lit(0).alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("value"),
    )


LINEITEM_LOG = """log AS (SELECT 'part/' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS key, l_orderkey + 1 AS main,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS sub,
    0 AS kind, l_returnflag || l_linestatus AS value FROM lineitem)"""


def documents_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source/lang/doc_id to the text's length."""
    d = read(spark, sf_dir, "documents")
    key = F.concat_ws("/", "source", "lang", F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return d.select(key.alias("key"), F.col("n_chars").cast("string").alias("value"))


DOCUMENTS_KV = "kv AS (SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS key, CAST(n_chars AS VARCHAR) AS value FROM documents)"


def user_key(n: Column) -> Column:
    return F.concat(F.lit("user/"), F.lpad(n.cast("string"), 8, "0"))


def compares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a compare per order; its customer, modulo 200, names the user's key; status and key pick target and operator."""
    o = read(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("version", "create", "mod", "value"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    op = F.when(F.col("o_orderkey") % 5 == 0, "!=").when(F.col("o_orderstatus") == "F", "=").when(F.col("o_orderstatus") == "O", ">").otherwise("<")
    return o.select(
        F.floor(F.col("o_orderkey") / 3).alias("txn_id"), (F.col("o_orderkey") % 3).cast("int").alias("cmp_no"), user_key(F.col("o_custkey") % 200).alias("key"), kind.alias("target_kind"),
        op.alias("op"), (F.col("o_orderkey") % 50).alias("target_i64"), F.lit("click:").alias("target_value"),
    )


COMPARES = """probes AS (SELECT CAST(floor(o_orderkey / 3.0) AS BIGINT) AS txn_id, CAST(o_orderkey % 3 AS INT) AS cmp_no, 'user/' || lpad(CAST(o_custkey % 200 AS VARCHAR), 8, '0') AS key,
    CASE o_orderkey % 4 WHEN 0 THEN 'version' WHEN 1 THEN 'create' WHEN 2 THEN 'mod' ELSE 'value' END AS target_kind,
    CASE WHEN o_orderkey % 5 = 0 THEN '!=' WHEN o_orderstatus = 'F' THEN '=' WHEN o_orderstatus = 'O' THEN '>' ELSE '<' END AS op, o_orderkey % 50 AS target_i64, 'click:' AS target_value FROM orders)"""


def txn_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two ops per order: a put of a new key, and a delete of ten users' keys."""
    o = read(spark, sf_dir, "orders")
    txn, base = F.col("o_orderkey").alias("txn_id"), F.col("o_custkey") % 200
    put = o.select(txn, F.lit(0).alias("op_no"), F.lit("put").alias("op"), F.concat(F.lit("new/"), F.col("o_orderkey").cast("string")).alias("key"), F.lit("").alias("end"), F.col("o_orderpriority").alias("value"))
    delete = o.select(txn, F.lit(1).alias("op_no"), F.lit("delete_range").alias("op"), user_key(base).alias("key"), user_key(base + 10).alias("end"), F.lit(None).cast("string").alias("value"))
    return put.unionByName(delete)


TXN_OPS = """o AS (SELECT * FROM orders),
ops AS (SELECT o_orderkey AS txn_id, 0 AS op_no, 'put' AS op, 'new/' || CAST(o_orderkey AS VARCHAR) AS key, '' AS "end", o_orderpriority AS value FROM o
    UNION ALL SELECT o_orderkey, 1, 'delete_range', 'user/' || lpad(CAST(o_custkey % 200 AS VARCHAR), 8, '0'), 'user/' || lpad(CAST(o_custkey % 200 + 10 AS VARCHAR), 8, '0'), NULL FROM o)"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a watcher of six users' keys per nation, and one of all keys."""
    n = read(spark, sf_dir, "nation")
    own = n.select(F.col("n_nationkey").cast("long").alias("watcher_id"), user_key(F.col("n_nationkey") * 6).alias("range_start"), user_key(F.col("n_nationkey") * 6 + 6).alias("range_end"), (F.col("n_nationkey") * 10).cast("long").alias("start_rev"))
    return own.unionByName(spark.createDataFrame([(999, "a", "z", 1)], own.schema))


SUBSCRIPTIONS = """subs AS (SELECT CAST(n_nationkey AS BIGINT) AS watcher_id, 'user/' || lpad(CAST(n_nationkey * 6 AS VARCHAR), 8, '0') AS range_start,
    'user/' || lpad(CAST(n_nationkey * 6 + 6 AS VARCHAR), 8, '0') AS range_end, CAST(n_nationkey * 10 AS BIGINT) AS start_rev FROM nation UNION ALL SELECT 999, 'a', 'z', 1)"""


def raft_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replicated log with a gap after every 997th entry."""
    e = read(spark, sf_dir, "events").where("event_id % 997 <> 5")
    return e.select((F.col("event_id") + 1).alias("index"), (F.floor(F.col("event_id") / 100) + 1).alias("term"), F.when(F.col("event_id") % 10 == 0, "ConfChangeV2").otherwise("Normal").alias("entry_type"), F.col("props").alias("data"))


RAFT_ENTRIES = """entries AS (SELECT event_id + 1 AS "index", CAST(floor(event_id / 100.0) AS BIGINT) + 1 AS term,
    CASE WHEN event_id % 10 = 0 THEN 'ConfChangeV2' ELSE 'Normal' END AS entry_type, props AS data FROM events WHERE event_id % 997 <> 5)"""


def bench_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paired runs per ship flag, a run per month: the mean price with and without discount."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    runs = l.groupBy(F.col("l_returnflag").alias("metric"), month.alias("run_index")).agg(
        F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount")) + 1).alias("ours"), F.avg(F.col("l_extendedprice") + 1).alias("theirs")
    )
    return runs.select("metric", "ours", "theirs", (F.col("metric") == "R").alias("lower_is_better"))
