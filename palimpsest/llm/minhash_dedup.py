"""Near-duplicates: universal hash minima, banding, verification, and connected components.

* A document's set is its distinct 5-word shingles (lower-cased A-Z).  Documents with equal
  sets form a class and are linked at once; only one representative of a class goes on, so
  thousands of copies cost one row each.
* Bands of minima of universal hash functions, as many as the threshold asks for (`scheme`): a
  pair at the threshold agrees in no band with probability (1 - 0.85^7)^40 = 2e-7 for 0.85, and
  (1 - 0.8^6)^51 = 2e-7 for 0.8.
* Candidates come from buckets without emitting their pairs.  Every member is paired with the
  bucket's smallest; pairs are estimated by their signatures and confirmed on the full sets, and
  the links label the members.  Then each bucket that still spans several labels is
  searched, the members outside its largest label against all others, in blocks bounded by
  members and by shingles: once for each such member's most similar partner, and once, with the
  labels that these links give, exhaustively.  There a block holds the full sets of the members
  that have a plausible partner in it, compares them all, and hands on only the links that join
  components: less than it has members, however many pairs are alike.
* Components by alternating large-star and small-star steps.

Sets, classes and bands are compared by 64-bit hashes.

Defined results: null or empty text has an empty set and is linked with nothing; a null
doc_id is linked with nothing, has a null component and is kept; rows that share a doc_id
are one node; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, grouped, mapped, materialise, mix, table

SHINGLE = 5
#: A link: 100 * intersection >= threshold * union.  The query's threshold, and that of the pipeline's stage.
THRESHOLD, STAGE_THRESHOLD = 85, 80
#: Most minima of a document, and the probability that a pair at the threshold shares no band.
MINIMA, MISSED = 310, 2.5e-7
#: Members of a block, and their shingles, on average at most.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Documents to verify that are sent to all executors by id; beyond, texts are shuffled to them.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(85)
_A = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**64, MINIMA, dtype=np.uint64)


class Scheme(NamedTuple):
    threshold: int
    bands: int
    rows: int

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def estimate(self) -> float:
        """Signature estimate under which a pair is not fetched for verification: 5 standard deviations below the threshold."""
        t = self.threshold / 100
        return t - 5 * (t * (1 - t) / self.minima) ** 0.5


def scheme(threshold: int) -> Scheme:
    """The longest bands that miss a pair at the threshold (in percent, below 100) with probability MISSED and fit into MINIMA."""
    bands = lambda rows: math.ceil(math.log(MISSED) / math.log1p(-((threshold / 100) ** rows)))
    fit = [Scheme(threshold, bands(rows), rows) for rows in range(1, 33) if rows * bands(rows) <= MINIMA]
    if not fit:
        raise ValueError(f"no bands of {MINIMA} minima for a threshold of {threshold} %")
    return fit[-1]


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, sorted, document after document; and where each begins."""
    words = Words([x.lower() for x in texts])
    hashes, at = words.runs(size)
    owner = words.document[at] if len(at) else at
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < size))
    extra = np.zeros(len(short), np.uint64)
    for k, i in enumerate(short):
        h = np.uint64(n[i])
        for w in words.word[words.first[i] : words.first[i + 1]]:
            h = mix(np.array([h]))[0] ^ w
        extra[k] = h
    hashes, owner = np.concatenate([hashes, mix(extra)]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.concatenate([[True], (np.diff(owner) != 0) | (hashes[1:] != hashes[:-1])])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def _set_hash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5EED)), dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def signatures(docs: DataFrame, by: Scheme) -> DataFrame:
    """doc_id, n_shingles, class (hash of the set), signature (a byte of each minimum), bands; the last three null for empty sets."""

    def sign(slices: Iterator) -> Iterator:
        for texts, rows in slices:
            hashes, first = shingles(texts)
            n = np.diff(first)
            some = np.flatnonzero(n)
            kept = np.zeros((len(some), by.minima), np.uint64)
            if len(some):
                for j in range(by.minima):
                    kept[:, j] = np.minimum.reduceat((hashes * _A[j] + _B[j]) >> np.uint64(32), first[some])
            bands = np.zeros((len(some), by.bands), np.uint64)
            for j in range(by.rows):
                bands = mix(bands ^ kept[:, j :: by.rows])
            bands = mix(bands + np.arange(by.bands, dtype=np.uint64)).view(np.int64)
            low, every = (kept & np.uint64(255)).astype(np.uint8), _set_hash(hashes, first)
            of, signature, band = np.full(len(n), None), np.full(len(n), None), [None] * len(n)
            of[some] = every[some]
            for k, i in enumerate(some.tolist()):
                signature[i], band[i] = low[k].tobytes(), bands[k]
            yield rows, None, {"n_shingles": n, "class": of.tolist(), "signature": signature.tolist(), "bands": band}

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), sign, "n_shingles long, class long, signature binary, bands array<long>", ["doc_id"])


def _words(signatures: list[bytes], minima: int, fill: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, the last filled up."""
    out = np.full((len(signatures), -(-minima // 8) * 8), fill, np.uint8)
    out[:, :minima] = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, minima)
    return out


def _alike(a: np.ndarray, b: np.ndarray, minima: int) -> np.ndarray:
    """Estimated similarity of the signature a with each row of b."""
    same = np.bitwise_count((a == b).view(np.uint64)).sum(1, dtype=np.int64)
    return (same / minima - 1 / 256) * (256 / 255)


def estimated(pairs: DataFrame, members: DataFrame, by: Scheme) -> DataFrame:
    """The pairs (a, b) of classes that their signatures don't rule out."""
    one = members.select(F.col("class").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    two = members.select(F.col("class").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(-1, by.minima) for c in ("sa", "sb"))
            yield batch.loc[((a == b).mean(1) - 1 / 256) * (256 / 255) >= by.estimate, ["a", "b"]]

    near = pairs.join(one, "b").join(two, "a").where(f"100 * least(na, nb) >= {by.threshold} * greatest(na, nb)")
    return near.mapInPandas(test, "a long, b long")


def full_sets(wanted: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, set) of the wanted classes, from their smallest document's text."""
    wanted = materialise(wanted.distinct().join(members.select("class", "doc_id"), "class"))
    sent = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def sets(slices: Iterator) -> Iterator:
        for texts, rows in slices:
            hashes, first = shingles(texts)
            own = np.flatnonzero(_set_hash(hashes, first) == rows.column("class").to_numpy(zero_copy_only=False))
            if len(own):
                yield rows, own, {"set": [hashes[first[i] : first[i + 1]].view(np.int64) for i in own]}

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(sent, "doc_id")
    return materialise(mapped(texts, sets, "set array<long>", ["class"]).dropDuplicates(["class"]))


def confirmed(pairs: DataFrame, members: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs = materialise(pairs.distinct())
    full = full_sets(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))), members, docs)
    both = pairs.join(full.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b").join(full.select(F.col("class").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return materialise(both.where(100 * common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): alternating large-star and small-star until nothing changes; component is the smallest node."""

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        return e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    edges, before = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v")).distinct()
        before, edges = now, materialise(small_star(materialise(large_star(edges))))


def _contested(bucketed: DataFrame) -> DataFrame:
    """(key, class, component, main, members, others): the buckets of three or more that span several components; the last two in blocks.

    Buckets with the same members and components are searched once.
    """
    mark = F.xxhash64("class", "component").cast("decimal(38,0)")
    sizes = bucketed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"), F.sum(mark).alias("marks"))
    of_key = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("marks").alias("marks"))
    once = of_key.where("n > main.n and n > 2").groupBy("marks", "n", "w").agg(F.min(F.struct("key", "main")).alias("of"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    others = blocks(F.col("n") - F.col("of.main.n"), F.col("w") - F.col("of.main.w"))
    main = materialise(once.select("of.key", F.col("of.main.component").alias("main"), blocks(F.col("n"), F.col("w")).alias("members"), others.alias("others")))
    return materialise(bucketed.select("key", "class", "component").join(main, "key"))


def _cells(held: DataFrame) -> DataFrame:
    """Members outside a bucket's largest component against all its members, dealt into blocks: cells (key, i, j)."""
    block = lambda n, salt: F.pmod(F.xxhash64("class", F.lit(salt)), n.cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = ["key", "i", "j", "outside", "class", "component"]
    inside = held.withColumn("i", block(F.col("members"), 1).cast("int")).withColumn("j", every(F.col("others"))).withColumn("outside", F.lit(False))
    outside = held.where("component <> main").withColumn("j", block(F.col("others"), 2).cast("int")).withColumn("i", every(F.col("members"))).withColumn("outside", F.lit(True))
    return inside.select(rows).union(outside.select(rows))


def _plausible(cells: DataFrame, members: DataFrame, by: Scheme) -> DataFrame:
    """The cells' rows that have a partner of another component, on the other side, whose signature and size don't rule it out; and the most similar one."""

    def search(cell: dict[str, np.ndarray]) -> list[tuple]:
        o, m = np.flatnonzero(cell["outside"]), np.flatnonzero(~cell["outside"].astype(bool))
        rows: list[tuple] = []
        if len(o) and len(m):
            at = (cell["key"][0], cell["i"][0], cell["j"][0])
            so, sm = _words(cell["signature"][o].tolist(), by.minima, 0), _words(cell["signature"][m].tolist(), by.minima, 1)
            size, component, of = cell["n_shingles"], cell["component"], cell["class"]
            found = np.zeros(len(m), bool)
            for k, r in enumerate(o.tolist()):
                fits = np.flatnonzero((component[m] != component[r]) & (100 * np.minimum(size[m], size[r]) >= by.threshold * np.maximum(size[m], size[r])))
                alike = _alike(so[k], sm[fits], by.minima)
                near = fits[alike >= by.estimate]
                if len(near):
                    found[near] = True
                    rows.append((*at, True, of[r], component[r], of[m[fits[np.argmax(alike)]]], float(alike.max())))
            rows += [(*at, False, of[r], component[r], of[r], 0.0) for r in m[found].tolist()]
        return rows

    held = cells.join(members.select("class", "signature", "n_shingles"), "class")
    return grouped(held, ["key", "i", "j"], search, "key long, i int, j int, outside boolean, class long, component long, partner long, alike double")


def _forest(cells: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) inside cells, on full sets: those that join components, at most one less than a cell's members."""

    def link(cell: dict[str, np.ndarray]) -> list[tuple]:
        of, outside, component = cell["class"], cell["outside"].astype(bool), cell["component"].copy()
        size = np.array([len(x) for x in cell["set"]])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        shingle = np.unique(np.concatenate(cell["set"].tolist()), return_inverse=True)[1]
        held, found, inside = np.zeros(len(shingle), bool), [], np.flatnonzero(~outside)
        for k in np.flatnonzero(outside):
            held[:] = False
            held[shingle[first[k] : first[k] + size[k]]] = True
            common = np.add.reduceat(held[shingle], first, dtype=np.int64)[inside]
            for b in inside[100 * common >= threshold * (size[inside] + size[k] - common)]:
                if component[b] != component[k]:
                    found.append((max(of[k], of[b]), min(of[k], of[b])))
                    component[component == component[b]] = component[k]
        return found

    return grouped(cells.join(sets, "class"), ["key", "i", "j"], link, "a long, b long")


def linked(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept; links are pairs of at least `threshold` percent."""
    by = scheme(threshold)
    signed = materialise(signatures(docs, by))
    real = signed.where("class is not null and doc_id is not null")
    classes = materialise(real.groupBy("class").agg(F.min("doc_id").alias("least")))
    members = materialise(real.join(classes, "class").where("doc_id = least").dropDuplicates(["class"]).drop("least"))
    every = members.select("class", "n_shingles", F.explode("bands").alias("key"))
    buckets = materialise(every.groupBy("key").agg(F.min("class").alias("least"), F.count("*").alias("n")).where("n > 1"))
    bucketed = materialise(every.join(buckets, "key"))

    star = bucketed.where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct()
    links = confirmed(estimated(star, members, by), members, docs, threshold)
    hop = links.groupBy("a").agg(F.min("b").alias("b"))
    label = hop.join(hop.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select(F.col("a").alias("class"), F.least("b", "c").alias("component"))
    for search in ("partners", "forest"):
        labelled = bucketed.where("n > 2").select("class", "key", "n_shingles").join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))
        near = materialise(_plausible(_cells(_contested(labelled)), members, by))
        if search == "partners":
            best = near.where("outside").groupBy("class").agg(F.max_by("partner", F.struct("alike", "partner")).alias("partner"))
            more = confirmed(best.select(F.greatest("class", "partner").alias("a"), F.least("class", "partner").alias("b")), members, docs, threshold)
        else:
            cells = near.select("key", "i", "j", "outside", "class", "component")
            more = materialise(_forest(cells, full_sets(near.select("class"), members, docs), threshold).distinct())
        links = materialise(links.union(more))
        if search == "partners":
            label = materialise(components(links.toDF("u", "v")).withColumnRenamed("node", "class"))

    node = classes.select("class", F.col("least").alias("doc"))
    edges = links.join(node.select(F.col("class").alias("a"), F.col("doc").alias("u")), "a").join(node.select(F.col("class").alias("b"), F.col("doc").alias("v")), "b").select("u", "v")
    shared_ids = real.groupBy("doc_id").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("doc_id")
    same = real.select("doc_id", "class").join(shared_ids, "doc_id").join(node, "class").select(F.col("doc_id").alias("u"), F.col("doc").alias("v"))
    reached = components(edges.union(same)).withColumnRenamed("node", "doc")
    answer = materialise(node.join(reached, "doc", "left").select("class", F.coalesce("component", "doc").alias("component_id")))
    out = signed.select("doc_id", "n_shingles", "class").join(answer, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"), THRESHOLD)


#: The same rows from every pair of documents that share a shingle, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS k FROM d, UNNEST(range(1, greatest(1, len(ws) - 4) + 1)) AS t(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.least AS component_id, m.least = d.doc_id AS kept FROM d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
