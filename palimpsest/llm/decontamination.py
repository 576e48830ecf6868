"""Benchmark decontamination with a distributed positional inverted index.

* `build_index` stores the postings of all training tokens once, whatever the benchmark: one row
  per block of documents (of bounded bytes), with its sorted term dictionary and each term's list
  of places.  Blocks partition by document, so a hot source or term is spread over all of them
  and nothing is shuffled.
* `search` reads the stored index for each block of benchmark items.  A window's terms are looked
  up in an index block's dictionary; the list of the rarest there gives candidate starts, which
  are intersected with the other terms' lists, adjusted by their offsets, in order of rarity.
  Each start that is left is an exact phrase match.
* With `slop`, windows all of whose terms (with repeats) stand in any order within their length
  plus so many words are proximity matches; the rarest term's places choose the stretches.

Terms are lower-cased (A-Z) runs of letters, digits and non-ASCII characters, known by 64-bit
hashes.  Benchmark items are a stated query set: they are read in blocks of at most
`ITEMS_PER_BLOCK` items and about `WORDS_PER_BLOCK` words, which bounds the broadcast phrase table
for any benchmark size; a window is never cut.

Defined results: null or empty text has no words and is never contaminated; null item texts and
null item_ids have no windows; repeated document rows each get their own result row; repeated
items count once per item_id; other columns of the inputs are ignored; empty tables give no
rows, or no hits; texts of any length are searched whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, lists, mapped, materialise, table

WINDOW = 10
ITEMS_PER_BLOCK, WORDS_PER_BLOCK = 2000, 500_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(texts: list[bytes]) -> Words:
    return Words([x.translate(_FOLD) for x in texts])


class Phrases:
    """The windows of a block of items: term hashes, how many, and the items they are from."""

    def __init__(self, items: list[Row], window: int):
        self.items = sorted({str(r.item_id) for r in items if r.item_id is not None})  # the order of strings
        number = {x: k for k, x in enumerate(self.items)}
        found: dict[tuple, set[int]] = {}
        some = [r for r in items if r.item_id is not None and r.text is not None]
        words = terms([r.text.encode("utf-8", "replace") for r in some])
        for r, a, b in zip(some, words.first.tolist(), words.first[1:].tolist()):
            ids = words.word[a:b].tolist()
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(number[str(r.item_id)])
        self.length = np.array([len(x) for x in found], np.int64)
        self.owners = [sorted(x) for x in found.values()]
        self.windows = np.zeros((len(found), window), np.uint64)
        for k, x in enumerate(found):
            self.windows[k, : len(x)] = x
        self.inside = np.arange(window) < self.length[:, None]


def item_blocks(benchmark: DataFrame, window: int) -> Iterator[Phrases]:
    """The items, a bounded block at a time; one empty block if there are none."""
    block: list[Row] = []
    size, blocks = 0, 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append(row)
        size += len(row.text or "") // 4
        if len(block) >= ITEMS_PER_BLOCK or size >= WORDS_PER_BLOCK:
            yield Phrases(block, window)
            block, size, blocks = [], 0, blocks + 1
    if block or not blocks:
        yield Phrases(block, window)


_INDEX = "doc_id array<long>, text_hash array<long>, begin array<int>, term array<long>, first array<int>, place array<int>"


def build_index(docs: DataFrame) -> DataFrame:
    """The stored inverted index: by block of documents their ids, where each one's words begin in the block, the block's sorted terms, and where in `place` each one's places begin."""

    def postings(slices: Iterator) -> Iterator:
        for texts, rows in slices:
            words = terms(texts)
            place = np.argsort(words.word, kind="stable").astype(np.int32)
            term, first = np.unique(words.word[place], return_index=True)
            ids, hashes = (pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays([rows.column(c)])) for c in ("doc_id", "text_hash"))
            one = lambda x, kind: lists(x.astype(kind), np.array([0, len(x)]))
            yield None, None, {"doc_id": ids, "text_hash": hashes, "begin": one(words.first, np.int32), "term": one(term.view(np.int64), np.int64), "first": one(np.append(first, len(place)), np.int32), "place": one(place, np.int32)}

    return materialise(mapped(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), postings, _INDEX, also=["doc_id", "text_hash"]))


class Block:
    """The postings of one index row, and what intersecting them takes."""

    def __init__(self, row: dict[str, np.ndarray]):
        self.begin, self.term, self.first, self.place = row["begin"].astype(np.int64), row["term"].view(np.uint64), row["first"].astype(np.int64), row["place"].astype(np.int64)
        self.size = np.diff(self.first)
        # place lists as one ascending list of (term, place)
        self.keys = np.repeat(np.arange(len(self.term)) << 32, self.size) | self.place

    def look_up(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """The windows all of whose terms are here, and their terms' numbers."""
        if not len(self.term) or not len(p.windows):
            return np.zeros(0, np.int64), np.zeros((0, p.windows.shape[1]), np.int64)
        at = np.minimum(np.searchsorted(self.term, p.windows), len(self.term) - 1)
        alive = np.flatnonzero(((self.term[at] == p.windows) | ~p.inside).all(1))
        return alive, at[alive]

    def order(self, p: Phrases, alive: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each window's offsets, from its rarest term to its commonest."""
        return np.argsort(np.where(p.inside[alive], self.size[at], np.iinfo(np.int64).max), axis=1, kind="stable")

    def of_pivot(self, order: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of `at`, place) for all places of each window's rarest term."""
        each = np.arange(len(at))
        pivot = at[each, order[:, 0]]
        n = self.size[pivot]
        row = np.repeat(each, n)
        return row, self.place[np.repeat(self.first[pivot], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]

    def phrases(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """All (window, first place) by intersecting offset-adjusted lists, rarest term first."""
        alive, at = self.look_up(p)
        order = self.order(p, alive, at)
        row, place = self.of_pivot(order, at)
        start, length = place - order[row, 0], p.length[alive]
        document = np.searchsorted(self.begin, start, side="right") - 1
        keep = (document >= 0) & (start + length[row] <= self.begin[np.clip(document + 1, 0, len(self.begin) - 1)])
        row, start = row[keep], start[keep]
        for j in range(1, at.shape[1]):
            offset = order[row, j]
            key = (at[row, offset] << 32) | (start + offset)
            there = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key if len(key) else np.zeros(0, bool)
            keep = there | (j >= length[row])
            row, start = row[keep], start[keep]
        return alive[row], start

    def near(self, p: Phrases, slop: int) -> set[tuple[int, int]]:
        """(window, first place) of stretches of length + slop words of one document that begin with a term of the window and hold all its terms."""
        alive, at = self.look_up(p)
        order = self.order(p, alive, at)
        row, place = self.of_pivot(order, at)
        span = p.length[alive] + slop
        for j in range(1, at.shape[1]):  # every other term somewhere near the rarest one's place
            term = at[row, order[row, j]] << 32
            low = np.searchsorted(self.keys, term | np.maximum(place - span[row] + 1, 0))
            keep = (self.keys[np.minimum(low, len(self.keys) - 1)] <= (term | (place + span[row] - 1))) & (low < len(self.keys)) if len(row) else np.zeros(0, bool)
            keep |= j >= p.length[alive][row]
            row, place = row[keep], place[keep]
        dense = np.empty(len(self.place), np.int64)
        dense[self.place] = np.repeat(np.arange(len(self.term)), self.size)
        out: set[tuple[int, int]] = set()
        for r, c in zip(row.tolist(), place.tolist()):
            need = Counter(at[r, : p.length[alive[r]]].tolist())
            d = int(np.searchsorted(self.begin, c, side="right")) - 1
            for a in range(max(int(self.begin[d]), c - int(span[r]) + 1), c + 1):
                if int(dense[a]) in need and not need - Counter(dense[a : min(a + int(span[r]), int(self.begin[d + 1]))].tolist()):
                    out.add((int(alive[r]), a))
        return out


def search(index: DataFrame, phrases: Phrases, slop: int | None = None) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, hit (places inside a phrase match), items (ids as strings, sorted, of those with phrase matches), near (of those with proximity matches; empty without `slop`)."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                of = {c: batch.column(c)[i].values for c in batch.schema.names}
                block = Block({c: of[c].to_numpy() for c in ("begin", "term", "first", "place")})
                begin, n = block.begin, len(block.begin) - 1
                window, start = block.phrases(p)
                cover = np.zeros(begin[-1] + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + p.length[window], -1)
                hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)

                def owners(windows: list[int], starts: list[int], begin: np.ndarray = begin, n: int = n) -> list[list[str]]:
                    found: list[set[int]] = [set() for _ in range(n)]
                    for w, d in zip(windows, (np.searchsorted(begin, starts, side="right") - 1).tolist()):
                        found[d].update(p.owners[w])
                    return [[p.items[k] for k in sorted(x)] for x in found]

                near = sorted(block.near(p, slop)) if slop is not None else []
                first = np.searchsorted(hit, begin)
                document = np.searchsorted(begin, hit, side="right") - 1
                text = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        of["doc_id"], of["text_hash"], pa.array(np.diff(begin)), lists((hit - begin[document]).astype(np.int32), first),
                        pa.array(owners(window.tolist(), start.tolist()), text), pa.array(owners([w for w, _ in near], [a for _, a in near]), text),
                    ],
                    ["doc_id", "text_hash", "n_words", "hit", "items", "near"],
                )

    return index.mapInArrow(find, "doc_id long, text_hash long, n_words long, hit array<int>, items array<string>, near array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, hit (places), items and near (ids as strings, sorted)."""
    index = build_index(docs)
    found = [search(index, phrases, slop) for phrases in item_blocks(benchmark, window)]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    rows = every.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), both("hit"), both("items"), both("near"), (F.count("*") / len(found)).cast("int").alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def digest(hits: DataFrame) -> DataFrame:
    return hits.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: The same rows by windows of every length that items have.
ORACLE = r"""
WITH fold AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM fold),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + 9], ' ') AS k FROM b, UNNEST(range(1, greatest(1, len(ws) - 9) + 1)) AS t(p) WHERE len(ws) > 0),
w AS (SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM i) AS z, UNNEST(range(1, len(ws) - n + 2)) AS t(p)),
o AS (SELECT w.doc_id, w.p, w.n, i.item_id FROM w JOIN i ON i.n = w.n AND i.k = w.k),
h AS (SELECT doc_id, count(DISTINCT p + q) AS n FROM o, UNNEST(range(0, n)) AS t(q) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items, sha256(coalesce(x.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
"""
