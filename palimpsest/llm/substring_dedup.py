"""Substring deduplication by relative Lempel-Ziv parsing against all earlier documents.

The reference of a document is every document with a smaller doc_id, cut into blocks of
`BLOCK` words (and the `window` - 1 words behind them, so that each window starts in one block
and lies in it).  A document is factored, left to right and greedily, against the reference blocks
in which its windows of `window` words start first: a factor is the longest stretch of words
that also stands in these blocks, found through an index of the blocks' windows and compared word
by word.  Shorter stretches are literals.  Where a factor ends, the windows across its border
are looked up as well, so that a stretch which no single source holds is not lost; the next
factor begins at the first of them that is found.  The words inside factors are removed.

Blocks that hold none of its windows have no factor of `window` words to give.  The others are
found without comparing documents with each other:

1. `anchors`: the smallest of the hashed word triples inside a window is its anchor; equal
   windows have equal anchors, and neighbours mostly share theirs.  Anchors that occur in
   two documents are counted (with map-side partial sums, so a hot passage is no hot task)
   and noted in a bitmap, whose size grows with their number up to 2^MOST_BITS bits.  A false
   bit costs work, never a result.
2. `sources`: windows behind a noted anchor are grouped by their own hash to find an earlier
   document and the place in it.  Neighbours with one anchor travel in one row, dealt by the anchor,
   and are grouped where they arrive.  Windows of very frequent anchors are dealt one by one and salted,
   with as many salts as keep a group near `HOT` documents: all but the earliest of a salt have an
   earlier document there, and only the salts' winners are compared again.
3. `references`: the blocks so named, joined by document and number.  A block that a third of
   all documents need is one key of a join that Spark may split.

Defined results: null text has no words; a null doc_id is neither source nor shortened;
rows that share a doc_id are parts of one document number and never shorten each other; of
several earlier documents any may be a factor's source; longest ties fall to the smallest
source; other columns are ignored; an empty table gives no rows; texts of any length are
parsed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, lists, mapped, materialise, mix, table

WINDOW = 13
TRIPLE = 3
BLOCK = 64
#: Bits of the anchor bitmap for each noted anchor, and their base-2 logarithms at least and at most (256 MB).
BITS_EACH, LEAST_BITS, MOST_BITS, CHUNK_BITS = 256, 18, 31, 15
#: An anchor in this many documents, or in this share of all anchors if that is more, is salted.
HOT, HOT_SHARE = 2_000, 1e-5
#: Documents that are sent to all executors by id; beyond, texts are shuffled to them.
BROADCAST_IDS = 1_000_000


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window: its first word, and the hash of its anchor."""
    triple, at = words.runs(TRIPLE)
    by_word = np.full(len(words.word) + window, np.iinfo(np.uint64).max, np.uint64)
    by_word[at] = triple
    m = len(words.word) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best = by_word[:m].copy()
    for j in range(1, window - TRIPLE + 1):
        np.minimum(best, by_word[j : j + m], out=best)
    start = np.flatnonzero(words.document[:m] == words.document[window - 1 : window - 1 + m])
    return start, best[start]


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """Distinct (anchor, doc_id) of a batch."""

    def find(slices: Iterator) -> Iterator:
        for texts, rows in slices:
            words = Words(texts)
            start, anchor = _anchors(words, window)
            new = np.ones(len(anchor), bool)
            document = words.document[start]
            new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
            yield rows, document[new], {"anchor": anchor[new].view(np.int64)}

    return mapped(docs, find, "anchor long", ["doc_id"])


class Noted:
    """The bitmap of anchors in two documents or more, and the very frequent anchors (at most 1 / HOT_SHARE) with their salts."""

    def __init__(self, docs: DataFrame, window: int):
        counts = anchors(docs, window).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
        counts = materialise(counts.where("lo < hi").select("anchor", "n"))
        total, noted = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        self.bits = bits = min(MOST_BITS, max(LEAST_BITS, int(noted * BITS_EACH).bit_length()))
        bit = F.shiftrightunsigned("anchor", 64 - bits)
        chunks = counts.groupBy(F.shiftright(bit, CHUNK_BITS).cast("int").alias("chunk")).agg(F.collect_set((bit % (1 << CHUNK_BITS)).cast("int")).alias("bits"))  # at most 2^CHUNK_BITS

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                packed = []
                for bits in batch["bits"]:
                    flags = np.zeros(1 << CHUNK_BITS, np.uint8)
                    flags[np.asarray(bits, np.int64)] = 1
                    packed.append(np.packbits(flags, bitorder="little").tobytes())
                yield pd.DataFrame({"chunk": batch["chunk"], "packed": packed})

        self.bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for r in chunks.mapInPandas(pack, "chunk int, packed binary").toLocalIterator():
            at = r.chunk << (CHUNK_BITS - 3)
            self.bitmap[at : at + len(r.packed)] = np.frombuffer(r.packed, np.uint8)
        least = max(HOT, int(total * HOT_SHARE))
        hot = counts.where(F.col("n") >= least).orderBy("anchor").toPandas()
        self.hot, self.salts = hot["anchor"].to_numpy(np.int64), -(-hot["n"].to_numpy(np.int64) // least) + 1

    def holds(self, anchor: np.ndarray) -> np.ndarray:
        bit = anchor >> np.uint64(64 - self.bits)
        return (self.bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def salt(self, anchor: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """0, or for a very frequent anchor one of its salts, from 1."""
        if not len(self.hot):
            return np.zeros(len(anchor), np.int64)
        at = np.minimum(np.searchsorted(self.hot, anchor), len(self.hot) - 1)
        return np.where(self.hot[at] == anchor, doc_id % self.salts[at] + 1, 0)


def windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, place, salted, block, hashes): a document's distinct windows behind noted anchors, neighbours of one place in one row.

    Equal windows have equal places: their anchor, or their own hash and a salt if that is very frequent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Noted(docs, window))

    def find(slices: Iterator) -> Iterator:
        noted = shared.value
        for texts, rows in slices:
            words = Words(texts)
            start, anchor = _anchors(words, window)
            kept = np.flatnonzero(noted.holds(anchor))
            start, anchor = start[kept], anchor[kept].view(np.int64)
            hashes, at = words.runs(window)
            found, document = hashes[np.searchsorted(at, start)].view(np.int64), words.document[start]
            order = np.lexsort((found, document))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(found[order]) != 0) | (np.diff(document[order]) != 0)
            once = np.sort(order[new])  # a window that a document repeats counts once
            document, found = document[once], found[once]
            salt = noted.salt(anchor[once], rows.column("doc_id").to_numpy()[document])
            block = (start[once] - words.first[document]) // BLOCK
            own = mix(found.view(np.uint64) + salt.astype(np.uint64)).view(np.int64)
            place = (np.where(salt > 0, own, anchor[once]) >> 32).astype(np.int32)  # windows that share it by chance are told apart by hash
            first = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in (document, place, block, salt)], axis=0)])) if len(once) else once
            yield rows, document[first], {"place": place[first], "salted": salt[first] > 0, "block": block[first], "hashes": lists(found, np.append(first, len(found)))}

    return mapped(docs, find, "place int, salted boolean, block int, hashes array<long>", ["doc_id"])


def sources(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, source, block): for each document the blocks of earlier documents in which its windows also start."""
    found = windows(docs, window).repartition("place").select("doc_id", "place", "salted", "block", F.explode("hashes").alias("hash"))
    first = found.withColumn("first", F.min(F.struct("doc_id", "block")).over(Window.partitionBy("place", "hash"))).where("doc_id > first.doc_id or salted")
    winner = F.expr("salted and doc_id = first.doc_id")
    first = first.select("place", "doc_id", *(F.when(winner, F.col(c)).alias(c) for c in ("hash", "block")), F.col("first.doc_id").alias("source"), F.col("first.block").alias("source_block"))
    first = materialise(first.distinct().drop("place"))  # they lie by place: no exchange
    later = first.where("doc_id > source").select("doc_id", "source", F.col("source_block").alias("block"))
    winners = first.where("doc_id = source").groupBy("hash", "doc_id").agg(F.min("block").alias("block"))  # at most one a salt
    best = winners.withColumn("first", F.min(F.struct("doc_id", "block")).over(Window.partitionBy("hash"))).where("doc_id > first.doc_id")
    return later.union(best.select("doc_id", "first.doc_id", "first.block")).distinct()


def references(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(doc_id, reference): for each document the blocks wanted, as structs (source, block, words)."""
    wanted = materialise(wanted)
    ids = materialise(wanted.select(F.col("source").alias("doc_id")).distinct())
    held = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def cut(slices: Iterator) -> Iterator:
        for texts, rows in slices:
            at, number, part = [], [], []
            for i, text in enumerate(texts):
                words = text.split()
                for b in range(0, max(0, len(words) - window + 1), BLOCK):
                    at.append(i)
                    number.append(b // BLOCK)
                    part.append(b" ".join(words[b : b + BLOCK + window - 1]))
            yield rows, at, {"block": number, "words": part}

    blocks = mapped(held, cut, "block int, words binary", ["doc_id"]).withColumnRenamed("doc_id", "source")
    return wanted.join(blocks, ["source", "block"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source", "block", "words"))).alias("reference"))


class Reference:
    """The blocks that one document is parsed against, with an index of their windows."""

    def __init__(self, blocks: list[dict], window: int):
        self.words: list[bytes] = []
        self.ends: list[int] = []
        self.source: list[int] = []
        last = None
        for b in blocks:
            words = b["words"].split()
            if last and last[:2] == (b["source"], b["block"] - 1) and last[2] == words[: window - 1]:  # goes on where the one before ends
                self.words += words[window - 1 :]
                self.ends[-1] = len(self.words)
            else:
                self.words += words
                self.ends.append(len(self.words))
                self.source.append(b["source"])
            last = (b["source"], b["block"], words[1 - window :])
        self.first = [0, *self.ends[:-1]]
        held = Words([b" ".join(self.words[a:b]) for a, b in zip(self.first, self.ends)])
        hashes, at = held.runs(window)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], at[order]


def parse(words: list[bytes], windows: np.ndarray, reference: Reference, window: int) -> list[tuple[int, int, int]]:
    """The factors (first word, words, source) of a document, whose `windows` are hashed from each word on."""
    low, high = (np.searchsorted(reference.hashes, windows, side=side) for side in ("left", "right"))
    known, out, ends = np.flatnonzero(high > low).tolist(), [], np.array(reference.ends)
    k, free = 0, 0
    while k < len(known):
        p = known[k]
        if p < free:  # inside the last factor, and not across its border
            k = int(np.searchsorted(known, free))
            continue
        longest, source = 0, -1
        for q in reference.at[low[p] : high[p]].tolist():
            part = int(np.searchsorted(ends, q, side="right"))
            most = min(len(words) - p, reference.ends[part] - q)
            if longest >= most or words[p : p + longest + 1] != reference.words[q : q + longest + 1]:
                continue
            n, step = longest + 1, window
            while n < most and step:  # longer and longer steps, then shorter ones
                m = min(step, most - n)
                if words[p + n : p + n + m] == reference.words[q + n : q + n + m]:
                    n, step = n + m, step * 2
                else:
                    step = m // 2
            longest, source = n, reference.source[part]
        if longest >= window:
            out.append((p, longest, source))
            free = p + longest - window + 1
        k += 1
    return out


def factored(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row: doc_id, n_words, n_removed, kept (the kept words joined by one space), and its factors: first word, words, source."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = docs.where("doc_id is not null")
    by_document = references(known, sources(known, window), window)

    def reduce(slices: Iterator) -> Iterator:
        for texts, rows in slices:
            held = rows.column("reference").to_pylist()
            some = [i for i, x in enumerate(held) if x]
            hashed = Words([texts[i] for i in some])
            hashes, at = hashed.runs(window)
            first = np.searchsorted(at, hashed.first)
            n_words, n_removed, kept, factors = [], [], [], []
            number = {i: k for k, i in enumerate(some)}
            for i, text in enumerate(texts):
                words, found = text.split(), []
                if i in number:
                    k = number[i]
                    found = parse(words, hashes[first[k] : first[k + 1]], Reference(held[i], window), window)
                cover = np.zeros(len(words) + 1, np.int64)
                for p, n, _ in found:
                    cover[p] += 1
                    cover[p + n] -= 1
                left = np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist() if found else range(len(words))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join([words[j] for j in left] if found else words).decode("utf-8", "replace"))
                factors.append(found)
            begin = np.cumsum([0, *map(len, factors)])
            column = lambda j: lists(np.array([f[j] for x in factors for f in x], np.int64), begin)
            yield rows, None, {"n_words": n_words, "n_removed": n_removed, "kept": kept, "factor_start": column(0), "factor_words": column(1), "factor_source": column(2)}

    joined = docs.join(by_document.hint("shuffle_hash"), "doc_id", "left")
    added = "n_words long, n_removed long, kept string, factor_start array<long>, factor_words array<long>, factor_source array<long>"
    return mapped(joined, reduce, added, ["doc_id"], also=["reference"])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factored(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows by windows: a word goes if it is inside a window that also starts in a smaller document.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
r AS (SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM l),
w AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS source FROM r WHERE p + 12 <= n),
g AS (SELECT DISTINCT doc_id, p + k AS p FROM w, UNNEST(range(0, 13)) AS t(k) WHERE source < doc_id),
k AS (SELECT l.doc_id, string_agg(word, ' ' ORDER BY l.p) FILTER (g.p IS NULL) AS kept, count(g.p) AS n FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
