"""Decontamination, nearest neighbours, packing and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, neighbours, packing, url_filter
from palimpsest.llm.common import Words, table
from tests.llm import brute

DATA = "/root/testdata/sf0.01"
ROWS = brute.hard_texts()
ITEMS = [(1, "  ".join(ROWS[0][1].split()[3:18])), (2, ROWS[44][1].upper()), (10, "one"), (11, None), (12, ""), (3, "never seen words here at all but ten of them x y"), (3, "One two")]


def test_words_and_runs():
    texts = [b"a b  c\td", b"", b" b c d ", "é b c d".encode()]
    w = Words(texts)
    flat = [x for t in texts for x in t.split()]
    assert [len(t.split()) for t in texts] == np.diff(w.first).tolist()
    for i, x in enumerate(flat):
        for j, y in enumerate(flat):
            assert (w.word[i] == w.word[j]) == (x == y)
    hashes, at = w.runs(3)
    runs = [tuple(flat[k : k + 3]) for k in at]
    assert runs == [(b"a", b"b", b"c"), (b"b", b"c", b"d"), (b"b", b"c", b"d"), ("é".encode(), b"b", b"c"), (b"b", b"c", b"d")]
    assert len(set(hashes.tolist())) == 3


@pytest.mark.parametrize("block", [2000, 2])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", block)
    docs = brute.documents(spark, ROWS)
    items = spark.createDataFrame([(*x, "c") for x in ITEMS], "item_id long, text string, term string")
    got = decontamination.digest(decontamination.contamination(docs.union(docs.limit(4)), items))
    want = brute.contamination(ROWS, ITEMS)
    rows = got.collect()
    assert len(rows) == len(ROWS) + 4 and any(x[-1] for x in want.values())
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == want
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert not decontamination.digest(decontamination.contamination(docs, items.limit(0))).where("contaminated").count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a q b c z"), (2, "c b a"), (3, "a q q q b c"), (4, "a b"), (5, "b c"), (6, "q a"), (7, "a c A b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c"), (8, "a b a c")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near) for r in decontamination.contamination(docs, items, 10, 1).collect()}
    assert got == {1: ([], ["7"]), 2: ([], ["7"]), 3: ([], []), 4: ([], []), 5: ([], []), 6: ([], []), 7: ([], ["7", "8"])}


def test_proximity_by_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 40)))) for i in range(40)]
    items = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))) for k in range(6)]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4, 2)
    want = {}
    for i, t in docs:
        w, own = t.split(), set()
        for k, x in items:
            x = x.split()
            for part in (x[j : j + 4] for j in range(max(1, len(x) - 3))):
                if any(not Counter(part) - Counter(w[a : a + len(part) + 2]) for a in range(len(w))):
                    own.add(str(k))
        want[i] = sorted(own)
    assert {r.doc_id: r.near for r in got.collect()} == want and any(want.values())


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_PER_BLOCK", 2)
    items = spark.createDataFrame([(k, "a b") for k in range(4)], "item_id long, text string")
    assert [len(p.items) for p in decontamination.item_blocks(items, 10)] == [2, 2]
    assert [len(p.items) for p in decontamination.item_blocks(items.limit(0), 10)] == [0]


def test_neighbours_recall_and_order(spark):
    rows = table(spark, DATA, "embeddings")
    got = neighbours.op5_neighbours(spark, DATA).collect()
    data = rows.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in data], float), np.array([r.vec_id for r in data])
    found = hit = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in ids.tolist() if i % 20 == 0}
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        at = np.flatnonzero(ids == q)[0]
        s = x @ x[at]
        assert all(r.score == pytest.approx(s[np.flatnonzero(ids == r.vec_id)[0]], rel=1e-12) for r in rs)
        s[at] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        found, hit = found + 20, hit + len(best & {r.vec_id for r in rs})
    assert hit / found >= 0.9


def test_neighbours_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = random.Random(5)
    same = [0.6, 0.8, 0.0]
    rows = [(i, same) for i in range(60)] + [(60 + i, [math.cos(a), math.sin(a) * 0.6, math.sin(a) * 0.8]) for i, a in enumerate(rng.uniform(2, 4) for _ in range(60))]
    bad = [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 2.0]), (280, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0]), (None, same), (320, [1.0, 2.0])]
    table_ = spark.createDataFrame([(*r, "c", 1) for r in [*rows, *bad]], "vec_id long, embedding array<float>, cell string, block int").repartition(3)
    got = neighbours.nearest(table_, table_.where("vec_id % 20 = 0")).where("query_id < 60").collect()
    for q in (0, 20, 40):
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert [v for _, v in mine] == [i for i in range(60) if i != q][:20]
    assert neighbours.nearest(table_.limit(0), table_.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.8, 0.3])], "vec_id long, embedding array<double>")
    assert [(r.vec_id) for r in neighbours.nearest(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize(("n", "spread"), [(15, 0), (25, 0), (500, 0), (2000, 1.0)])
def test_neighbours_full_lists(spark, n, spread):
    """Few rows, and rows of very different lengths: full lists, and at least 0.9 of the true ones."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32))
    x *= rng.lognormal(0, spread, (n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in neighbours.nearest(rows, rows.where("vec_id % 20 = 0")).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s)[: min(20, n - 1)].tolist())
        assert len(by[q]) == len(best)
        hits += len(best & by[q]) / len(best)
    assert hits / len(by) >= 0.9


def test_plan_covers_the_histogram():
    rng = np.random.default_rng(2)
    for case in ({}, {4096: 3}, {1: 5}, {4095: 2, 1: 2}, {n: int(c) for n, c in zip(range(1, 4096), rng.integers(0, 4, 4095))}, {2049: 9, 2048: 1}, {1000: 10_000_000, 7: 3}):
        groups = packing.plan(dict(case))
        used = {}
        for n, parts in groups:
            assert n > 0 and sum(length * m for length, m in parts) <= 4096
            for length, m in parts:
                used[length] = used.get(length, 0) + n * m
        assert used == {k: v for k, v in case.items() if v}
        total = sum(k * v for k, v in case.items())
        if total > 4096 * 500 and len(case) > 100:
            assert sum(n for n, _ in groups) <= 1.01 * total / 4096


def test_patterns_place_most_tokens(spark):
    pieces = packing.tokenised(table(spark, DATA, "documents"), packing.tokenizer_file())
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    assert packing.pattern_share(histogram) >= 0.5
    tokens = sum(k * v for k, v in histogram.items())
    assert sum(n for n, _ in packing.plan(histogram)) <= 1.01 * tokens / 4096


def test_nnls_equals_an_exhaustive_search():
    """Against the least residual over all subsets of columns whose unconstrained solution is not negative."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.integers(0, 3, (4, 6)).astype(float), rng.integers(0, 9, 4).astype(float)
        x = packing.nnls(a, b)
        best = min(
            np.linalg.norm(a[:, at] @ y - b) for n in range(1, 5) for at in map(list, combinations(range(6), n)) for y in [np.linalg.lstsq(a[:, at], b, rcond=None)[0]] if (y >= -1e-9).all()
        )
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= min(best, np.linalg.norm(b)) * 1.02 + 1e-2


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [*ROWS, (70, "İ ﬁ Ω don't I'LL 5²½ <|endoftext|> \u00a0x"), (70, "twice"), (70, "twice"), (None, "no id")]
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack(brute.documents(spark, rows), packing.tokenizer_file()).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= -(-sum(x[3] for x in want) // 4096) + 1
    assert packing.pack(brute.documents(spark, rows).limit(0), packing.tokenizer_file()).count() == 0


def test_pipeline_stages(spark):
    """Each stage against the plain version of its decision, on its own input."""
    import corpus_pipeline as p
    from palimpsest.llm.common import materialise

    docs = table(spark, DATA, "documents")
    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    steps = dict(p.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "minhash_dedup", "decontamination", "packing"]
    for name in list(steps)[:-1]:
        before = rows(docs)
        out = materialise(steps[name](spark, docs, DATA))
        assert out.columns == docs.columns
        after = rows(out)
        if name == "line_dedup":
            kept = brute.runs_removed(before, 3, 25)
            assert dict(after) == {i: t for i, t in kept.items() if t or dict(before)[i] == ""}
            assert out.where(F.col("n_chars") != F.char_length("text")).count() == docs.where(F.col("n_chars") != F.char_length("text")).count()
        if name == "minhash_dedup":
            reach = brute.components(brute.shingle_sets(before), 80)
            assert {i for i, _ in after} == {i for i, c in reach.items() if i == c}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
            assert {i for i, _ in after} == {i for i, x in brute.contamination(before, items).items() if not x[-1]}
        docs = out
    assert {r.doc_id for r in steps["packing"](spark, docs, DATA).collect()} == {i for i, _ in after}


def test_urls_tokens_beyond_the_broadcast_count(spark, monkeypatch):
    urls = [f"https://h{i % 5}.example.{end}/{lang}/w{i % 7}/w{i % 7}/v{i % 3}" for i in range(60) for end, lang in (("com", "en"), ("net", "de"), ("io", "xx"))]
    pages = spark.createDataFrame([(i, u, "<p>some words</p>") for i, u in enumerate([*urls, None])], "page_id long, url string, html string")
    rows = lambda: {r.page_id: (r.verdict, round(r.block_log_odds, 9)) for r in url_filter.judged(pages).collect()}
    whole = rows()
    for most in (1, 3, 8):
        monkeypatch.setattr(url_filter, "TOKENS", most)
        assert rows() == whole
