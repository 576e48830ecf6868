"""Random logs against an independent per-key model: snapshots, previous versions and keep-sets, all cases in one job."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import history


def _random_case(seed):
    rnd, live, rows, main = random.Random(seed), {}, [], 0
    for _ in range(32):
        what, key = rnd.random(), rnd.choice("abcdefgh")
        if what < 0.6:
            main += 1
            rows.append((f"{seed}/{key}", main, 0, 0, str(rnd.random())))
            live[key] = True
        else:
            end = rnd.choice("bcdefghi")
            hit = sorted(k for k in live if key <= k < end)
            if hit:
                main += 1
                rows += [(f"{seed}/{k}", main, i, 1, None) for i, k in enumerate(hit)]
                for k in hit:
                    del live[k]
    return rows


def _model(rows, at):
    """key -> (create, mod, version, value) at a main revision, replaying in order."""
    out = {}
    for key, main, sub, kind, value in sorted(rows, key=lambda r: r[1:3]):
        if main > at:
            break
        if kind:
            out.pop(key, None)
        elif key in out:
            out[key] = (out[key][0], (main, sub), out[key][2] + 1, value)
        else:
            out[key] = ((main, sub), (main, sub), 1, value)
    return out


def test_random_logs(spark):
    cases = [_random_case(s) for s in range(60)]
    rows = [r for c in cases for r in c]
    log = spark.createDataFrame(rows, "key string, main long, sub long, kind int, value string").cache()
    for at in (1, 5, 9, 14, 30):
        want = {k: v for c in cases for k, v in _model(c, at).items()}
        got = {r.key: ((r.create_main, r.create_sub), (r.mod_main, r.mod_sub), r.version, r.value) for r in history.visible_at(log, at).collect()}
        assert got == want
        assert {(r.key, (r.main, r.sub)) for r in history.keep_set(log, at).collect()} == {(k, v[1]) for k, v in want.items()}
        # every revision from `at` on reads the same after compaction
        kept = history.compacted(log, at)
        for later in (at, at + 4):
            a = kept.where(F.col("main") <= later).groupBy("key").agg(F.max(F.struct("main", "sub", "kind", "value", "version")).alias("r")).where("r.kind = 0").select("key", "r.main", "r.sub", "r.version", "r.value")
            assert {r.key: (r.main, r.sub, r.version, r.value) for r in a.collect()} == {k: (*v[1], *v[2:]) for c in cases for k, v in _model(c, later).items()}
    got = {(r.key, r.main, r.sub): (r.prev_main, r.prev_sub, r.prev_version) for r in history.with_previous(log).collect()}
    for case in cases:
        last = {}
        versions = {}
        for key, main, sub, kind, _ in sorted(case, key=lambda r: r[1:3]):
            assert got[key, main, sub] == last.get(key, (None, None, None))
            if kind:
                versions[key] = 0
            else:
                versions[key] = versions.get(key, 0) + 1
                last[key] = (main, sub, versions[key])
    assert history.quality(log).count() == 0


def test_log_quality_faults(spark):
    rows = [("a", 1, 0, 1), ("b", 1, 0, 0), ("b", 1, 0, 0), ("c", 1, 0, 0), ("c", 2, 0, 1), ("c", 3, 0, 1)]
    got = history.quality(spark.createDataFrame([(*r, None) for r in rows], "key string, main long, sub long, kind int, value string")).collect()
    assert sorted((r.key, r.main, r.fault) for r in got) == [("a", 1, "TombstoneOnEmpty"), ("b", 1, "NonMonotonic"), ("c", 3, "TombstoneOnEmpty")]
