"""Line, substring and near-duplicate removal against brute force, on hard documents."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import line_dedup, minhash_dedup, substring_dedup
from palimpsest.llm.common import Words
from tests.llm import brute

ROWS = brute.hard_texts()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark, ROWS).cache()


def test_lines(docs):
    got = line_dedup.deduplicated(docs).select("row.*")
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == brute.line_dedup(ROWS)


def test_lines_repeated_rows_count_once(spark, docs):
    twice = line_dedup.deduplicated(docs.union(docs)).select("row.*").collect()
    assert len(twice) == 2 * len(ROWS) and {r.doc_id: r.text for r in twice} == brute.line_dedup(ROWS)


def test_lines_short_runs_of_many_characters(spark):
    """One or two lines go as well if they are long; tiny and blank lines alone stay, but go inside a run."""
    long, ten = "a line that is long enough to count", "0123456789"
    rows = [(1, f"{long}\n\nx"), (2, f"y\n{long}"), (3, long), (4, f"x\n\n{ten}{ten}\n{ten}"), (5, f"z\n{ten}{ten}\n{ten}\nw"), (6, f"{ten}{ten}\nx\n\n"), (7, f"{long}\n\nq\n\nx"), (8, None), (9, "")]
    for least, want in ((None, {2: f"y\n{long}", 3: long}), (25, {2: "y", 3: "", 5: "z\nw", 6: f"{ten}{ten}\nx\n\n", 7: "q\n\nx"})):
        got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=least).select("row.*").collect()}
        assert want.items() <= got.items() and got == brute.runs_removed(rows, 3, least or 10**9)


def test_lines_by_characters(docs):
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(docs, min_chars=25).select("row.*").collect()}
    assert got == brute.runs_removed(ROWS, 3, 25) and got != brute.line_dedup(ROWS)


def test_lines_suffix_array(spark, docs):
    """The whole array: ranks order the repeated suffixes, equal ranks are equal suffixes, and each group's longest common prefix with the one before."""
    array, levels = line_dedup.suffix_array(line_dedup.line_ids(docs))
    found = array.collect()
    texts = dict(ROWS)
    line = {r.dd_doc: texts[r.dd_doc].split("\n") for r in found}
    every = [tuple(t.split("\n")[p:]) for _, t in ROWS if t is not None for p in range(len(t.split("\n")))]
    starts = [x[0] for x in every]
    suffix = {(r.dd_doc, r.pos): tuple(line[r.dd_doc][r.pos :]) for r in found}
    assert len(suffix) == len(found) == sum(starts.count(x) > 1 for x in starts)
    of_rank = {}
    for r in found:
        assert of_rank.setdefault(r["rank"], suffix[r.dd_doc, r.pos]) == suffix[r.dd_doc, r.pos]
    assert len(set(of_rank.values())) == len(of_rank)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = {r["rank"]: (r.n, r.lcp) for r in line_dedup.common_prefixes(array, levels).collect()}
    order = sorted(of_rank)
    assert sorted(lcp) == order and max(x for _, x in lcp.values()) >= 4
    for before, after in zip(order, order[1:]):
        adjoin = before + lcp[before][0] == after
        assert lcp[after][1] == (common(of_rank[before], of_rank[after]) if adjoin else 0)
        assert adjoin or common(of_rank[before], of_rank[after]) == 0
    for m in (1, 2, 3, 5):  # every pair that shares m lines is in one stretch with that many in common
        stretch, number = {}, 0
        for k in order:
            number += lcp[k][1] < m
            stretch[k] = number
        for a in order:
            for b in order:
                assert (common(of_rank[a], of_rank[b]) >= m) == (stretch[a] == stretch[b] and (a != b or len(of_rank[a]) >= m))


def test_substrings(docs):
    got = substring_dedup.factored(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == brute.substrings(ROWS)
    assert all(s < r.doc_id for r in got for s in r.factor_source) and all(n >= substring_dedup.WINDOW for r in got for n in r.factor_words)


def test_parse_equals_a_brute_force_parse():
    """Greedy longest factors against blocks, and what their borders add, by trying every place."""
    rnd = random.Random(8)
    for case in range(60):
        alphabet = [b"a", b"b", b"c", b"dd"][: 2 + case % 3]
        doc = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))]
        blocks = [[rnd.choice(alphabet) for _ in range(rnd.randint(4, 30))] for _ in range(6)]
        for b in blocks[:3]:
            if len(doc) > 20:
                at = rnd.randrange(len(doc) - 10)
                b[2:2] = doc[at : at + rnd.randint(3, 20)]
        reference = substring_dedup.Reference([{"source": k, "block": 5 * k, "words": b" ".join(b)} for k, b in enumerate(blocks)], 4)
        windows = Words([b" ".join(doc)]).runs(4)[0]
        got = substring_dedup.parse(doc, windows, reference, 4)

        def longest(p, doc=doc, blocks=blocks):
            best = (0, 0)
            for k, b in enumerate(blocks):
                for q in range(len(b)):
                    n = 0
                    while p + n < len(doc) and q + n < len(b) and doc[p + n] == b[q + n]:
                        n += 1
                    best = max(best, (n, -k))
            return best

        want, p = [], 0
        while p < len(doc):
            n, source = longest(p)
            if n >= 4:
                want.append((p, n, -source))
                p += n - 3
            else:
                p += 1
        assert got == want


def test_reference_blocks_join():
    """Blocks that follow each other are one stretch again."""
    words = [b"w%d" % k for k in range(150)]
    blocks = [{"source": 3, "block": k, "words": b" ".join(words[64 * k : 64 * k + 76])} for k in range(3)]
    reference = substring_dedup.Reference(blocks, 13)
    assert reference.words == words and reference.ends == [150] and reference.source == [3]
    assert substring_dedup.parse(words[5:140], Words([b" ".join(words[5:140])]).runs(13)[0], reference, 13) == [(0, 135, 3)]


def test_substrings_salted(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    got = substring_dedup.factored(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == brute.substrings(ROWS)


@pytest.mark.parametrize("hot", [2_000, 3])
def test_substrings_deal_neighbours_in_one_row(spark, monkeypatch, hot):
    """Every distinct window of a repeated passage is dealt once a document, most of them in one row with others of their block."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    passage = [f"w{k * k % 1009}" for k in range(400)]
    rows = [(i, " ".join([f"own{i}", *passage[i:], f"end{i}", *passage[:30]])) for i in range(8)]
    held = [(r, h) for r in substring_dedup.windows(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect() for h in r.hashes]
    want = {i: set(Words([" ".join(passage[i:]).encode(), " ".join(passage[:30]).encode()]).runs(13)[0].view("int64").tolist()) for i, _ in rows}
    found = [(r.doc_id, h) for r, h in held]
    assert len(set(found)) == len(found) and {(i, h) for i in want for h in want[i]} <= set(found)
    assert all(r.block <= len(passage) // substring_dedup.BLOCK + 1 for r, _ in held)
    if hot > 3:  # not salted: one place for each window, several windows a row
        assert len({(h, r.place) for r, h in held}) == len({h for _, h in held}) and not any(r.salted for r, _ in held)
        assert 3 * len({(r.doc_id, r.place, r.block, tuple(r.hashes)) for r, _ in held}) < len(held)
    else:
        assert all(len(r.hashes) == 1 for r, _ in held if r.salted) and any(r.salted for r, _ in held)


def test_substrings_null_and_shared_ids(spark):
    t = " ".join(map(str, range(20)))
    got = substring_dedup.factored(spark.createDataFrame([(None, t), (5, t), (5, t), (6, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (5, 0), (5, 0), (6, 20)]


def _components(got):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()}


def test_near_duplicates(docs):
    sets = brute.shingle_sets(ROWS)
    reach = brute.components(sets)
    assert any(reach[i] != i for i in reach)
    assert _components(minhash_dedup.linked(docs)) == {i: (len(sets[i]), reach[i], reach[i] == i) for i in sets}


def test_near_duplicates_chain(spark):
    """Neighbours are alike, ends are not: every link counts, found or not through the bucket's smallest."""
    words = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 200])) for i in range(24)]
    sets = brute.shingle_sets(rows)
    want = {i: (len(sets[i]), c, c == i) for i, c in brute.components(sets).items()}
    assert {c for _, c, _ in want.values()} == {0}
    assert _components(minhash_dedup.linked(brute.documents(spark, rows))) == want


def test_forest_of_a_cell(spark):
    """Only links that join components, on full sets, and all of the components that the cell's links make."""
    base = list(range(100))
    sets = {1: base, 2: [*base[5:], 200, 201], 3: [*base[10:], 300], 4: list(range(500, 560)), 5: list(range(503, 563)), 6: [*base[:60], *range(900, 940)]}
    cells = [(9, 0, 0, True, c, c) for c in (2, 3, 5, 6)] + [(9, 0, 0, False, c, c) for c in sets] + [(9, 0, 1, True, 5, 5), (9, 0, 1, False, 4, 4)]
    made = minhash_dedup._forest(
        spark.createDataFrame(cells, "key long, i int, j int, outside boolean, class long, component long"), spark.createDataFrame(list(sets.items()), "class long, set array<long>"), 85
    )
    got = {(r.a, r.b) for r in made.collect()}
    alike = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})
    assert len(got) == 3 and all(alike(a, b) for a, b in got)
    assert {frozenset(x) for x in got if 5 in x or 4 in x} == {frozenset((4, 5))} and {c for x in got for c in x} == {1, 2, 3, 4, 5}


def test_near_duplicates_at_the_stage_threshold(spark):
    """Pairs between 0.8 and 0.85 are linked at 80 and by the pipeline's stage, not at 85."""
    words = [f"w{k}" for k in range(6000)]
    rows = [(i, " ".join(words[i // 2 * 300 : i // 2 * 300 + 200] if i % 2 == 0 else words[i // 2 * 300 + 20 : i // 2 * 300 + 220])) for i in range(40)]
    sets = brute.shingle_sets(rows)
    assert all(0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.85 for i in range(0, 40, 2))
    full = brute.documents(spark, rows).cache()
    for threshold in (80, 85):
        reach = brute.components(sets, threshold)
        assert sum(reach[i] != i for i in reach) == {80: 20, 85: 0}[threshold]
        assert _components(minhash_dedup.linked(full, threshold)) == {i: (len(sets[i]), reach[i], reach[i] == i) for i in sets}
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, full, "").collect()) == list(range(0, 40, 2))


def test_near_duplicates_scheme():
    assert minhash_dedup.scheme(85)[1:] == (40, 7) and minhash_dedup.scheme(80)[1:] == (51, 6)
    assert all((1 - (t / 100) ** s.rows) ** s.bands <= minhash_dedup.MISSED and s.minima <= minhash_dedup.MINIMA for t in range(10, 100) for s in [minhash_dedup.scheme(t)])


def test_near_duplicates_nulls_and_repeats(spark):
    t = " ".join(map(str, range(30)))
    got = minhash_dedup.linked(spark.createDataFrame([(None, t), (7, t), (7, t), (9, t), (8, None)], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted([(None, None, True), (7, 7, True), (7, 7, True), (9, 7, False), (8, 8, True)], key=repr)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.component for r in minhash_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{k: 100 for k in range(100, 160)}}


@pytest.mark.parametrize("operator", [line_dedup.deduplicated, substring_dedup.factored, minhash_dedup.linked])
def test_empty_table(docs, operator):
    assert operator(docs.limit(0)).count() == 0
