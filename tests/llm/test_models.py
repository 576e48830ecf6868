"""Quality, toxicity, language model and URL filter: exact parts against brute force, models on held-out rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import class_lm, quality, toxicity, url_filter
from palimpsest.llm.common import Words, table
from tests.llm import brute

DATA = "/root/testdata/sf0.01"
ROWS = brute.hard_texts()


def test_language_model_counts(spark):
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in class_lm.scored(brute.documents(spark, ROWS)).collect()}
    for i, want in brute.base_scores(ROWS).items():
        assert got[i][:4] == want[:4] and got[i][4] == pytest.approx(want[4], rel=1e-9)


def test_language_model_joins_rare_words(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "LOOKED_UP", 0.01)
    rows = brute.documents(spark, ROWS)
    a = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in class_lm.scored(rows.union(rows)).collect()}
    want = brute.base_scores([*ROWS, *ROWS])
    assert a == {i: (w[2], round(w[4], 6)) for i, w in want.items()}


def test_language_model_is_a_distribution(spark):
    """Over every known word and the unknown ones of each class, probabilities after any class sum to one."""
    train = brute.documents(spark, ROWS)
    counts = class_lm.word_counts(train).cache()
    m = class_lm.Model(counts, train)
    emitted = np.zeros(class_lm.END + 1)
    np.add.at(emitted, m.known.kind.astype(int), 10**m.emit)
    for r in counts.where(F.col("c") < m.cut).collect():
        emitted[r.ending] += (r.c - m.discount[r.ending]) / m.mass[r.ending]
    emitted[: class_lm.ENDINGS] += 10**m.unknown
    emitted[class_lm.END] = 1
    used = [k for k in range(class_lm.END + 1) if emitted[k]]
    assert np.allclose(emitted[used], 1) and np.allclose((10**m.transition).sum(1), 1)


def test_language_model_scores_by_brute_force(spark, monkeypatch):
    """Every probability counted plainly from the training texts, given only the words' classes."""
    monkeypatch.setattr(class_lm, "CORE", 4)
    rows = [(i, t) for i, t in ROWS if t is None or len(t) < 3000] + [(None, "One two one")]
    docs = brute.documents(spark, rows)
    train = docs.where(~class_lm.held_out(F.col("doc_id"))).select("text")
    m = class_lm.Model(class_lm.word_counts(train).cache(), train)
    split = lambda t: brute.SPACED.findall(brute.low(t))
    learned = dict(zip(m.known.words.tolist(), m.known.kind.tolist()))
    hashed = lambda w: int(Words([w.encode()]).word[0])
    kind = lambda w: learned[hashed(w)] if hashed(w) in learned else int(class_lm.tokens([w.encode()])[1][0])
    texts = [split(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts, end = Counter(w for t in texts for w in t), class_lm.END
    assert {hashed(w) for w, c in counts.items() if c >= 2} == set(learned) and len(set(learned.values())) > 3
    steps = Counter(p for t in texts for c in [[end, *map(kind, t), end]] for p in zip(c, c[1:]))
    out_of, into = Counter(), Counter()
    for (a, b), n in steps.items():
        out_of[a] += n
        into[b] += n
    total, size = sum(steps.values()), end + 1
    mass, once, twice, kinds = Counter(), Counter(), Counter(), Counter()
    for w, c in counts.items():
        mass[kind(w)] += c
        if hashed(w) not in learned:
            kinds[kind(w)] += 1
            once[kind(w)] += c == 1
            twice[kind(w)] += c == 2

    def emission(w):
        k = kind(w)
        if hashed(w) in learned:
            return counts[w] / mass[k]
        d = min(0.95, max(0.05, once[k] / (once[k] + 2 * twice[k]))) if once[k] else 0.5
        return (counts[w] - d) / mass[k] if counts[w] else d * kinds[k] / mass[k] if mass[k] else 1.0

    for r in class_lm.scored(docs).where("doc_id is not null").collect():
        t = split(dict(rows)[r.doc_id])
        c = [end, *map(kind, t), end]
        step = lambda a, b: (steps[a, b] + class_lm.SMOOTH * (into[b] + 1) / (total + size)) / (out_of[a] + class_lm.SMOOTH)
        assert r.score == pytest.approx(sum(np.log10(step(a, b)) for a, b in zip(c, c[1:])) + sum(np.log10(emission(w)) for w in t), rel=1e-9)
    assert class_lm.scored(docs.limit(0)).count() == 0


def test_language_model_classes_of_rare_words(spark, monkeypatch):
    """Words that occur twice or more have the class that fits them best, however small their share; scores follow from the classes by plain counting."""
    monkeypatch.setattr(class_lm, "CORE", 4)
    monkeypatch.setattr(class_lm, "LOOKED_UP", 0.01)
    monkeypatch.setattr(class_lm, "FITS", 5)
    rows = [(i, t) for i, t in ROWS if t is None or len(t) < 3000]
    rows += [(70 + i, f"{a} zig{i % 3} zag{i % 4} zig{i % 3} {b}") for i, (a, b) in enumerate(zip("the on er a one thy".split() * 3, "a one the er on two".split() * 3))]
    docs = brute.documents(spark, rows)
    train = docs.where(~class_lm.held_out(F.col("doc_id"))).select("text")
    counted = class_lm.word_counts(train).cache()
    m = class_lm.Model(counted, train)
    hashed = lambda w: int(Words([w.encode()]).word.view(np.int64)[0])
    ending = lambda w: int(class_lm.tokens([w.encode()])[1][0])
    kinds = dict(zip(m.known.words.view(np.int64).tolist(), m.known.kind.tolist())) | {r.word: r["class"] for r in m.rest.collect()}
    kind = lambda w: kinds.get(hashed(w), ending(w))
    split = lambda t: brute.SPACED.findall(brute.low(t))
    texts = [split(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, end, size = Counter(w for t in texts for w in t), class_lm.END, class_lm.END + 1
    rare = {w for w, c in counts.items() if c < m.cut}
    assert sum(counts[w] > 1 for w in rare) > 20 and all((kind(w) >= class_lm.ENDINGS) == (c > 1) for w, c in counts.items())

    of = m.known.kind.astype(np.int64)
    encoded = class_lm.encoded(train, m.known)
    fits = class_lm._fits(class_lm.bigrams(encoded, of, size))
    before = lambda w: ending(w) if w in rare or w not in counts else kind(w)
    weight = {w: np.zeros(class_lm.CLASSES) for w in rare}
    for t in texts:
        c = [end, *map(before, t), end]
        for i, w in enumerate(t):
            if w in rare:
                weight[w] += fits[c[i]] + fits[size + c[i + 2]]
    assert all(weight[w][kind(w) - class_lm.ENDINGS] == pytest.approx(weight[w].max(), rel=1e-9) for w in rare if counts[w] > 1)

    steps = Counter(p for t in texts for c in [[end, *map(kind, t), end]] for p in zip(c, c[1:]))
    table_ = np.zeros((size, size))
    for p, n in steps.items():
        table_[p] = n
    prior = (table_.sum(0) + 1) / (table_.sum() + size)
    log_step = np.log10((table_ + class_lm.SMOOTH * prior) / (table_.sum(1, keepdims=True) + class_lm.SMOOTH))
    mass, once = Counter(), Counter()
    for w, c in counts.items():
        mass[kind(w)] += c
        once[kind(w)] += c == 1

    def emission(w):
        if counts[w] != 1:
            return counts[w] / mass[kind(w)] if counts[w] else 0.95 * once[kind(w)] / mass[kind(w)] if mass[kind(w)] else 1.0
        return (1 - 0.95) / mass[kind(w)]

    edges = Counter((a in rare) + (b in rare) for t in texts for a, b in zip(t, t[1:]))
    assert min(edges[0], edges[1], edges[2]) > 20
    for r in class_lm.scored(docs).collect():
        t = split(dict(rows)[r.doc_id])
        c = [end, *map(kind, t), end]
        assert r.score == pytest.approx(sum(log_step[p] for p in zip(c, c[1:])) + sum(np.log10(emission(w)) for w in t), rel=1e-9)


def test_language_model_beats_unigrams_on_held_out_text(spark):
    h = class_lm.op8_class_lm(spark, DATA).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert h[1] > h[0]


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    group = np.arange(200) % 2  # words of two kinds that follow each other by turns
    first = rng.integers(0, 200, 20000)
    second = rng.integers(0, 100, 20000) * 2 + (1 - group[first])
    pairs, n = np.unique(np.stack([first, second]), axis=1, return_counts=True)
    of, total = class_lm.exchange(pairs[0] + class_lm.END + 1, pairs[1] + class_lm.END + 1, n.astype(float), 200)
    assert total.sum() == n.sum() and total.min() >= 0
    assert not set(of[group == 0]) & set(of[group == 1])


def test_restoration(spark):
    text = "you stupid idiot and worthless moron trash disgusting the and of to in that with for as on at by clown " * 30
    model = toxicity.character_model(spark.createDataFrame([(text,)], "text string"))
    restore = toxicity.Restorer(model)
    for seen, want in {"stup1d": "stupid", "$tupid": "stupid", "m0ron": "moron", "tr@sh": "trash", "w.o.r.t.h.l.e.s.s": "worthless", "stuuupid": "stupid", "d1sgu$ting": "disgusting", "the&&&": "the", "the": "the"}.items():
        assert toxicity.restored(seen, restore) == want
    spelled = {toxicity.restored(w, restore) for w in toxicity.words("so s t u p i d, m.o.r.o.n and  i d 1 o t  c l o w n.")}
    assert {"so", "stupid", "moron"} < spelled and any("idiot" in w.split() or "idiotclown" in w for w in spelled)


def test_restoration_by_brute_force():
    """Viterbi's spelling is the likeliest of all paths through the lattice."""
    rng = np.random.default_rng(7)
    model = np.log10(rng.dirichlet(np.ones(toxicity._SIZE), (toxicity._SIZE, toxicity._SIZE)))
    restore = toxicity.Restorer(model)

    def paths(word, i=0):
        if i == len(word):
            yield 0.0, ""
            return
        for to, letters, cost in restore.edges(word, i):
            for more, rest in paths(word, to):
                yield cost + more, letters + rest

    def score(letters):
        a = b = total = 0
        for c in [*letters, " "]:
            k = 0 if c == " " else toxicity._CODE.get(c, toxicity._OTHER)
            total += model[a][b][k]
            a, b = b, k
        return total

    for word in ("st1", "a.b", "s t 0", "aab$", "x y z", "b||", "4 b.1", "$$", "a", "e--e"):
        best = max(cost + score(letters) for cost, letters in paths(word))
        spellings = {letters for cost, letters in paths(word) if cost + score(letters) >= best - 1e-9}
        assert restore(word) in spellings


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op9_toxicity(spark, DATA).join(table(spark, DATA, "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    assert np.mean([r.predicted for r in got if not r.toxic]) < 0.02


def test_toxicity_hard_rows(spark):
    docs = brute.documents(spark, [*ROWS, (None, "x"), (50, None)])
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (None, 1, 1), (2, None, None), (3, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = toxicity.toxicity(docs, some).collect()
        assert len(got) == len(ROWS) + 2 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_quality_keeps_the_good(spark):
    labels = table(spark, DATA, "labels").select("doc_id", "quality")
    kept = quality.op1_quality(spark, DATA)
    share = {r.quality: r.s for r in labels.join(kept.select("doc_id", "kept"), "doc_id", "left").groupBy("quality").agg(F.avg(F.col("kept").isNotNull().cast("int")).alias("s")).collect()}
    assert share[1] > 0.97 and share[0] < 0.2


def test_quality_weights_by_brute_force(spark):
    rows = [(i, t) for i, t in ROWS if i < 60]
    docs = brute.documents(spark, rows)
    wanted = docs.where("doc_id < 7")
    ratio = quality.log_ratio(quality.bucket_counts(wanted), quality.bucket_counts(docs))

    def buckets(text):
        one = [int(quality.mix(np.array([zlib.crc32(x.encode())], np.uint64))[0]) for x in re.findall(r"\w+|[^\w\s]+", text or "")]
        two = [int(quality.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(one, one[1:])]
        return [x % quality.BUCKETS for x in one + two]

    raw, target = (Counter(b for i, t in rows if i < top for b in buckets(t)) for top in (60, 7))
    n, size, strength = sum(raw.values()), quality.BUCKETS, quality.SMOOTH * quality.BUCKETS
    p = lambda b: (raw[b] + 1) / (n + size)
    weight = lambda t: sum(np.log((target[b] + strength * p(b)) / (sum(target.values()) + strength) / p(b)) for b in buckets(t))
    for r in quality.weighted(docs.select("doc_id", "text"), ratio).collect():
        assert r.log_weight == pytest.approx(weight(dict(rows)[r.doc_id]), rel=1e-9, abs=1e-9) and r.drawn > r.log_weight - 5


def test_quality_weights_and_kth(spark):
    values = spark.createDataFrame([(float(x),) for x in np.random.default_rng(1).normal(0, 50, 500)] + [(3.0,)] * 5, "v double")
    order = sorted((r.v for r in values.collect()), reverse=True)
    for k in (1, 7, 250, 505):
        assert quality.kth_largest(values, "v", k) == pytest.approx(order[k - 1], abs=1e-5)
    docs = brute.documents(spark, [*ROWS, (None, "y")])
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.resampled(docs, labels).count() >= len(docs.collect()) // 2
    assert quality.resampled(docs, labels.limit(0)).count() == len(ROWS) + 1
    assert quality.resampled(docs.limit(0), labels).count() == 0


def test_url_rules(spark):
    urls = ["https://a.example.com/en/77", "http://x.com/en/1?q=/en/", "https://example.net/de/8#x", "https://net/de/9", "HTTP://A.ORG/es/", "http://xorg/es/", "no scheme", None, "a://b://c/d", "http://h.example.com"]
    pages = spark.createDataFrame([(i, u, "<p>ththre thre</p>", "c", "c") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, words string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got[0] == ("a.example.com", "/en/77", "example.com/en/7", "allow")
    assert got[1] == ("x.com", "/en/1", "com/en/", "block")
    assert got[2] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4] == ("a.org", "/es/", "org/es/", "block")
    assert got[5][2] is None and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[8][:2] == ("b:", "//c/d")
    assert all(v in ("allow", "block") for *_, v in got.values())
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_segmentation(spark):
    """Viterbi against all ways to cut, and through the lexicon's join."""
    counts = {"news": 100, "paper": 30, "newspaper": 1, "a": 500, "pap": 2, "er": 2, "pa": 9}
    total = sum(counts.values())
    shares = {w: np.log10(n / total) for w, n in counts.items()}
    unknown = -np.log10(total) - 1

    def cuts(x):
        return [[x[:i], *rest] for i in range(1, len(x) + 1) for rest in (cuts(x[i:]) if x[i:] else [[]])]

    cost = lambda words: sum(shares.get(w, unknown - 0.8 * len(w)) for w in words)
    labels = ["newspaper", "apaper", "zzqpaper", "anewsa", "q", "paperer"]
    for x in labels:
        got = url_filter.segment(x, shares, total)
        assert "".join(got) == x and cost(got) == pytest.approx(max(map(cost, cuts(x))))
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = url_filter.segmented(spark.createDataFrame([(x,) for x in [*labels, "y" * 64]], "label string"), words).collect()
    assert {r.label: r.words for r in rows} == {**{x: url_filter.segment(x, shares, total) for x in labels}, "y" * 64: ["y" * 64]}
    hosts = spark.createDataFrame([("newspaper7.a-zzq.a",), ("",), ("newspaper7.a-zzq.a",)], "host string")
    assert [r.words for r in url_filter.host_words(hosts, words).collect()] == [["news", "paper", "#", "a", "zzq", "a"]]


def test_url_verdicts_by_brute_force(spark):
    """Naive Bayes counted plainly over the tokens of the urls that a rule decides."""
    rng = np.random.default_rng(3)
    urls = [f"https://{rng.choice(['ab', 'abcd', 'cd9'])}.example.{rng.choice(['com', 'net', 'io'])}/{rng.choice(['en', 'de', 'xx'])}/{rng.choice(['p1', 'sale', 'blog'])}-{k % 5}" for k in range(80)]
    pages = spark.createDataFrame([(k, u, "<b>ab</b> ab cd io") for k, u in enumerate([*urls, *urls[:3], None, "none"])], "page_id long, url string, html string")
    rows = url_filter.judged(pages).collect()
    tokens = {r.page_id: [*(r.words or []), *("/" + ("#" if x.isdigit() else x) for x in re.findall(r"[^\W_]+", r.path.lower()))] for r in rows}
    decided = {r.page_id: r.verdict for r in rows if r.rule}
    counts = {v: Counter(t for i, x in decided.items() if x == v for t in tokens[i]) for v in ("block", "allow")}
    vocabulary = len({*counts["block"], *counts["allow"]})
    number = {v: sum(x == v for x in decided.values()) for v in counts}
    weight = lambda v, t: np.log((counts[v][t] + 1) / (sum(counts[v].values()) + vocabulary + 1))
    assert len(rows) == 85 and {r.verdict for r in rows if not r.rule} <= {"block", "allow"} and number["block"] and number["allow"]
    for r in rows:
        known = [t for t in tokens[r.page_id] if counts["block"][t] + counts["allow"][t]]
        odds = np.log((number["block"] + 1) / (number["allow"] + 1)) + sum(weight("block", t) - weight("allow", t) for t in known)
        assert r.block_log_odds == pytest.approx(odds) and (r.rule or r.verdict == ("block" if odds > 0 else "allow"))


def test_partitions_without_rows(spark):
    """Fewer rows than partitions: tasks without input hand on nothing."""
    from palimpsest.llm import decontamination, minhash_dedup, packing, substring_dedup

    rows = [(1, "a b c d e f"), (2, None), (9, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "x y")], "item_id long, text string")
    made = [class_lm.scored(docs), quality.resampled(docs, labels), toxicity.toxicity(docs, labels), minhash_dedup.linked(docs), substring_dedup.factored(docs)]
    made += [decontamination.contamination(docs, items), packing.pack(docs, packing.tokenizer_file())]
    assert [x.count() for x in made] == [3] * len(made)
