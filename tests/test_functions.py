"""Codec goldens, statistics and the generator."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import benchstats, raftlog


def test_codec_goldens(spark):
    rows = spark.createDataFrame([(1, 0, 0), (258, 3, 1), (0, 0, 0)], "main long, sub long, kind int").select(F.hex(codec.encode("main", "sub", "kind")).alias("x")).collect()
    assert [r.x for r in rows] == ["0000000000000001" + "5F" + "0" * 16, "0000000000000102" + "5F" + "0000000000000003" + "74", "0" * 16 + "5F" + "0" * 16]


def test_round_trip_and_faults(spark):
    good = spark.range(100).select(F.col("id").alias("main"), (F.col("id") * 3).alias("sub"), (F.col("id") % 2).cast("int").alias("kind"))
    k = codec.encode("main", "sub", "kind")
    assert good.where((codec.decode_main(k) != F.col("main")) | (codec.decode_sub(k) != F.col("sub")) | (codec.decode_kind(k) != F.col("kind"))).count() == 0
    bad = [b"", b"x" * 17, b"\x00" * 8 + b"_" + b"\x00" * 8 + b"u", b"\xff" * 8 + b"_" + b"\x00" * 8]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(bad)], "i int, k binary").orderBy("i").select(codec.decode_status("k").alias("s")).collect()
    assert [r.s for r in got] == ["BadLength", "BadSeparator", "UnknownMark", "NegativeRevision"]


def test_fnv_and_zipf(spark):
    def one(n):
        h = 0xCBF29CE484222325
        for b in int(n).to_bytes(8, "little"):
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h

    x = np.array([0, 1, 255, 2**40 + 7], np.uint64)
    assert benchstats.fnv1a(x).tolist() == [one(n) for n in x]
    items = benchstats.zipf_samples(spark, 20_000, 1000).groupBy("item").count().orderBy(F.desc("count")).limit(1).first()
    assert items.item == one(0) % 1000 and items["count"] > 20_000 / 27


def test_bootstrap_and_gate(spark):
    rows = [("m", 110.0 + i % 3, 100.0, False) for i in range(20)] + [("l", 50.0, 100.0, True) for _ in range(20)]
    got = {r.metric: r for r in benchstats.bootstrap(spark.createDataFrame(rows, "metric string, ours double, theirs double, lower_is_better boolean")).collect()}
    assert got["l"].low == got["l"].high == 2 and 1.09 < got["m"].low <= got["m"].ratio <= got["m"].high < 1.13
    gate = lambda *v: benchstats.gate(spark.createDataFrame([(str(i), x) for i, x in enumerate(v)], "metric string, verdict string")).first().passed
    assert gate("Win", "Tie") and not gate("Tie") and not gate("Win", "Loss") and not gate("Win", None)


def test_raft(spark):
    e = spark.createDataFrame([(i, 1) for i in (1, 2, 4, 5, 9)], "index long, term long")
    assert [(r["index"], r.expected) for r in raftlog.gaps(e).orderBy("index").collect()] == [(4, 3), (9, 6)]
    kept, cursor = raftlog.install_snapshot(e, 3, 4)
    assert cursor == 4 and tuple(raftlog.bounds(kept, cursor).first()) == (5, 9)
    assert tuple(raftlog.bounds(e.limit(0)).first()) == (0, 0) and tuple(raftlog.bounds(e.limit(0), 7).first()) == (8, 7)


def test_raft_append_and_state(spark):
    import pytest

    from palimpsest import errors
    from palimpsest.operators import raftlog

    rows = lambda *n: spark.createDataFrame([(i, t, "Normal", f"{i}.{t}") for i, t in n], "index long, term long, entry_type string, data string")
    log = raftlog.append(rows(*[]), rows((1, 1), (2, 1), (3, 1)))
    log = raftlog.append(log, rows((3, 2), (4, 2)))
    assert sorted(r.data for r in log.collect()) == ["1.1", "2.1", "3.2", "4.2"]
    for bad in (rows((6, 2)), rows((5, 2), (7, 2)), rows((5, 2), (5, 2))):
        with pytest.raises(errors.InvalidRange):
            raftlog.append(log, bad)
    with pytest.raises(errors.InvalidRange):
        raftlog.append(log, rows((2, 3)), last_index=2)
    assert [r["index"] for r in raftlog.entries_between(log, 2, 5).collect()] == [2, 3, 4]
    for low, high in ((0, 2), (2, 6), (3, 2)):
        with pytest.raises(errors.InvalidRange):
            raftlog.entries_between(log, low, high)
    assert raftlog.entries_between(log, 9, 9).count() == 0
    states = "seq long, term long, vote long, commit long"
    assert tuple(raftlog.hard_state(spark.createDataFrame([(1, 1, 2, 0), (3, 2, 1, 4), (2, 2, 1, 3)], states)).first()) == (2, 1, 4)
    assert tuple(raftlog.hard_state(spark.createDataFrame([], states)).first()) == (0, 0, 0)


def test_ranges_against_keys(spark):
    from palimpsest.operators import kv, ranges

    keys = [f"k{i:03d}" for i in range(0, 200, 3)]
    asked = [("k010", "k020"), ("k010", "k010"), ("k015", None), ("a", "b"), ("k003", "k004"), ("k1", "k2"), ("k050", "k040")]
    held = spark.createDataFrame([(k,) for k in keys], "key string").repartition(5)
    got = {(r.start, r.end, r.key) for r in ranges.matched(held, spark.createDataFrame(asked, "start string, end string")).collect()}
    assert got == {(a, b, k) for a, b in asked for k in keys if a <= k and (b is None or k < b)}
    placed = {r.key: r.place for r in ranges.counted(held, ["key"]).collect()}
    assert placed == {k: i for i, k in enumerate(keys)}
    table = held.withColumn("value", F.lit("v"))
    left = kv.delete_ranges(table, spark.createDataFrame([("k010", "k020"), ("k015", "k03"), ("k190", "")], "start string, end string"))
    assert {r.key for r in left.collect()} == {k for k in keys if not ("k010" <= k < "k03" or k >= "k190")}


def test_gate_skips_and_refuses(spark):
    import pytest

    from palimpsest import errors

    rows = spark.createDataFrame([("a", "Win", None), ("b", "Loss", "asymmetric"), ("c", None, "asymmetric")], "metric string, verdict string, fairness string")
    got = benchstats.gate(rows, ["a", "b", "c"]).first()
    assert (got.wins, got.losses, got.incomplete, got.skipped, got.passed) == (1, 0, 0, 2, True)
    with pytest.raises(errors.UnknownMetric):
        benchstats.gate(rows, ["a", "b"])
    rate = spark.range(1).select(benchstats.throughput(F.lit(500), F.lit(250_000_000)).alias("x")).first().x
    assert rate == 2000.0
