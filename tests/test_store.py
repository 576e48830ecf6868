"""The store end to end: the worked example, errors in order, conflicts, compaction, streams."""

import pytest

from palimpsest import errors
from palimpsest.sources.store import Manifest, Store
from palimpsest.streaming import watch


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"))


def _example(s):
    assert [s.put("a", "1"), s.put("b", "2"), s.put("a", "3"), s.delete_range("a", "c"), s.put("a", "5")] == [1, 2, 3, 4, 5]
    return s.txn([("a", "version", "=", 1, None)], [("put", "x", None, "6"), ("delete_range", "a", "b", None), ("put", "y", None, "7")], [])


def _at(s, r, start="a", end="zz", **more):
    return [(x.key, (x.create_main, x.create_sub), (x.mod_main, x.mod_sub), x.version) for x in s.range_at(start, end, r, **more).collect()]


def test_worked_example(store):
    assert _example(store) == (True, 6)
    assert _at(store, 1) == [("a", (1, 0), (1, 0), 1)]
    assert _at(store, 3) == [("a", (1, 0), (3, 0), 2), ("b", (2, 0), (2, 0), 1)]
    assert _at(store, 4) == []
    assert _at(store, 5) == [("a", (5, 0), (5, 0), 1)]
    assert _at(store, None) == [("x", (6, 0), (6, 0), 1), ("y", (6, 2), (6, 2), 1)]
    assert _at(store, 3, limit=1) == [("a", (1, 0), (3, 0), 2)] and _at(store, 3, limit=0) == []
    prev = {(e.key, e.main, e.sub): (e.prev_main, e.prev_version) for e in store.events(1).collect()}
    assert prev["a", 3, 0] == (1, 1) and prev["a", 4, 0] == (3, 2) and prev["b", 4, 1] == (2, 1) and prev["a", 5, 0] == (3, 2) and prev["a", 6, 1] == (5, 1)
    assert prev["x", 6, 0] == (None, None)
    before = _at(store, 5)
    store.compact(3)
    assert _at(store, 3) == [("a", (1, 0), (3, 0), 2), ("b", (2, 0), (2, 0), 1)] and _at(store, 5) == before
    with pytest.raises(errors.Compacted):
        store.range_at("a", "b", 2)
    with pytest.raises(errors.Compacted):
        store.events(3)
    assert store.put("b", "9") == 7 and _at(store, None, "b", None) == [("b", (7, 0), (7, 0), 1)]
    store.defragment()
    assert len(store.manifest().commits) == 1 and _at(store, 5) == before and store.size_on_disk() > 0


def test_nothing_written_takes_no_revision(store):
    store.put("a", "1")
    assert store.delete_range("x", "z") == 1 and store.delete_range("b") == 1
    assert store.txn([("a", "value", ">", None, "5")], [("put", "n", None, "1")], [("range", "a", None, None)]) == (False, 1)


def test_errors_in_order(store):
    store.put("a", "1")
    with pytest.raises(errors.FutureRevision):
        store.range_at("b", "a", 9)
    with pytest.raises(errors.InvalidRange):
        store.range_at("b", "a")
    with pytest.raises(errors.FutureRevision):
        store.compact(5)
    with pytest.raises(errors.EmptyKey):
        store.put("", "1")
    with pytest.raises(errors.NonEmpty):
        Store(store.spark, store.path, must_be_empty=True)
    with pytest.raises(errors.ReadOnly):
        Store(store.spark, store.path, read_only=True).put("a", "2")
    with pytest.raises(errors.ReadOnly):
        Store(store.spark, store.path + "-none", read_only=True)
    assert Store(store.spark, store.path).manifest().head == 1
    store.close()
    store.close()
    with pytest.raises(errors.Closed):
        store.manifest()


def test_buckets_and_batches(spark, store):
    store.register_bucket("one", 1)
    store.register_bucket("one", 1)
    with pytest.raises(errors.BucketConflict):
        store.register_bucket("two", 1)
    with pytest.raises(errors.BucketNameConflict):
        store.register_bucket("one", 2)
    ops = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "op_no int, op string, key string, value string")
    with pytest.raises(errors.UnknownBucket):
        store.commit_group([{"two": ops(("put", "a", "1"))}])
    old = store.manifest()
    store.commit_group([{"one": ops(("put", "a", "1"), ("put", "b", "2"), ("delete", "a", None))}, {"one": ops(("put", "c", "3"), ("put", "b", "4"))}])
    assert [tuple(r) for r in store.range("one", "a", "z").collect()] == [("b", "4"), ("c", "3")]
    assert store.bucket("one", old).count() == 0
    with pytest.raises(errors.InvalidRange):
        store.range("none", "b", "a")
    with pytest.raises(errors.EmptyKey):
        store.commit_group([{"one": ops(("put", "", "1"))}])
    with pytest.raises(errors.EmptyValue):
        store.commit_group([{"one": ops(("put", "k", ""))}])


def test_lost_race_plans_again(store):
    store.put("a", "1")
    raced = []
    publish = store._publish

    def late(manifest: Manifest) -> bool:
        if not raced:
            raced.append(1)
            Store(store.spark, store.path).put("b", "2")
        return publish(manifest)

    store._publish = late
    assert store.put("a", "3") == 3 and [k for k, *_ in _at(store, None)] == ["a", "b"]


def _rows(df):
    return [(r.key, r.main, r.sub, r.kind, r.value, r.prev_main, r.prev_version) for r in df.collect()]


def test_stream_delivers_published_commits_once(spark, store, tmp_path):
    """Across a lost race, defragmentation and compaction, in order, and from where it stopped."""
    raced, publish = [], store._publish

    def late(manifest: Manifest) -> bool:
        if not raced:
            raced.append(1)
            Store(spark, store.path).put("b", "2")
        return publish(manifest)

    got = []

    def run(name="c", **more):
        query = watch.follow(store, lambda events, _: got.extend(_rows(events)), str(tmp_path / name), availableNow=True, **more)
        query.awaitTermination()
        assert query.exception() is None

    store._publish = late
    assert store.put("a", "1") == 2
    store._publish = publish
    want = _rows(store.events(1))
    run(start_rev=1)
    assert got == want and [r[1] for r in got] == [1, 2]
    store.put("a", "3")
    store.defragment()
    run(start_rev=1)
    assert got == _rows(store.events(1)) and len(got) == 3
    store.compact(2)
    store.delete_range("a", "c")
    run(start_rev=3)
    assert got[:2] == want and got[2:] == _rows(store.events(3)) and len(got) == 5
    got.clear()
    run("other", start_rev=4, start="a", end="b")
    assert [(r[0], r[1]) for r in got] == [("a", 4)]
    for more, error in (({"start_rev": 2}, errors.Compacted), ({"start_rev": -1}, errors.FutureRevision), ({"start": "b", "end": "a"}, errors.InvalidRange)):
        with pytest.raises(error):
            run("never", **more)


def test_watchers_hand_over_and_end(spark, store, tmp_path):
    """Catch-up, then live events of the same watcher without a gap or a repeat; counts and reasons."""
    store.put("a", "1")
    got = []
    query = watch.follow(store, lambda events, _: got.extend(_rows(events)), str(tmp_path / "c"), start_rev=1, processingTime="0 seconds")
    query.processAllAvailable()
    assert [r[1] for r in got] == [1] and watch.watchers(spark) == 1 and watch.end_reason(query, store) is None
    store.put("b", "2")
    store.delete_range("a", "c")
    query.processAllAvailable()
    query.stop()
    assert got == _rows(store.events(1)) and watch.watchers(spark) == 0 and watch.end_reason(query, store) == "Cancelled"

    def broken(events, _):
        raise ValueError("no such sink")

    failed = watch.follow(store, broken, str(tmp_path / "d"), start_rev=1, availableNow=True)
    with pytest.raises(Exception, match="no such sink"):
        failed.awaitTermination()
    assert watch.end_reason(failed, store).startswith("Internal: ")


def test_claims(spark, store):
    """A number is claimed once, no reader sees a manifest without its text, and a dead writer's claim can be taken back."""
    store.put("a", "1")
    number = store.manifest().number + 1
    assert store.files.create(f"{store.path}/claims/{number:012d}", "")
    assert store.manifest().number == number - 1
    with pytest.raises(errors.CommitConflict):
        store.register_bucket("one", 1)
    store.release()
    assert store.put("a", "2") == 2


def test_put_all(spark, store):
    rows = spark.range(1000).selectExpr("concat('k', lpad(cast(id as string), 8, '0')) as key", "concat('v', id) as value")
    store.put_all(rows)
    store.delete_range("k", "k00000500")
    assert store.manifest().head == 2 and store.range_at("k", "l").count() == 500
    store.compact(2)
    assert store.range_at("k", "l").count() == 500


def test_results_of_writes_and_reads(store):
    for k in "abcd":
        store.put(k, k.upper())
    passed, head, responses = store.txn_responses(
        [("a", "version", "!=", 2, None)], [("range", "a", "z", None), ("delete_range", "b", "d", None), ("put", "e", None, "E"), ("delete_range", "a", "d", None)], []
    )
    assert (passed, head) == (True, 5) and responses[1:] == [2, None, 1]
    assert [r.key for r in responses[0].collect()] == ["d", "e"]
    assert store.txn_responses([("a", "version", ">", 0, None)], [], [("range", "d", None, None)])[2][0].first().value == "D"
    assert store.range_meta("a", "z", 4, 2) == (4, True, 5) and store.range_meta("a", "z") == (2, False, 5)
    assert store.delete_counted("d", "f") == (2, 6) and store.delete_counted("d", "f") == (0, 6)
