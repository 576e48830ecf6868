"""Brown class-based bigram language model with smoothed perplexity.

P(word | word before) = P(class | class before) * P(word | class).

* Words are counted over every training document.  The `CORE` most frequent are put into
  `CLASSES` classes by exchange clustering: each word in turn moves to the class that raises
  the class bigrams' likelihood most.  This works on the bigrams of these words, a table of
  at most (CORE + ENDINGS + CLASSES + 1)^2 counts, under 10 MB.
* All other words with a share of at least `LOOKED_UP` of all tokens are assigned by exchange
  steps against those fixed classes, each word by itself, in Spark: its counts of classes
  before and after it are summed over the corpus, and it joins the class under which they are
  likeliest.  `SWEEPS` such steps are made; after each, class bigrams are counted anew.
* All rarer words that occur twice or more are then assigned by such a step as well.  They are no
  table in a task: their occurrences are grouped by word, and class bigrams are corrected
  for the edges to words of known class, and for edges between two rare words by joins.
* Words that occur once stand for unknown words; both take a class by their ending.
  Emissions of ending classes are discounted: seen words keep c - D, the class's unknown
  word gets D times its distinct words (D = n1 / (n1 + 2 n2)).  Transitions are smoothed
  towards the class unigram.
* Scoring: words with a share of `LOOKED_UP` (at most 1 / LOOKED_UP, 14 bytes each) are looked up
  in the task; rarer ones meet their classes and counts in joins by word, in which no word can be hot.

Tokens are words without ASCII white space, A-Z lower-cased, and one end per document.
Words are known by 64-bit hashes.

Defined results: null and empty texts are one end token; a null doc_id is held out; with no
training rows every token is unknown; identical rows score alike; words that tie in a count
are ordered by hash, and a word that fits two classes alike takes the first; other columns
are ignored; an empty table gives no rows; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Words, lists, mapped, materialise, mix, table

#: Words clustered together, and the least share of all tokens of a word that tasks look up.
CORE, LOOKED_UP = 512, 5e-7
CLASSES, ENDINGS = 96, 64
EXCHANGES, SWEEPS = 4, 2
#: Weight of the class unigram in a transition, in tokens.
SMOOTH = 20.0
#: Distinct keys a task counts before it hands them on.
FLUSH = 1_500_000

END = ENDINGS + CLASSES  # the last class: end of one document, start of the next
RARE = END + 1  # in contexts, a neighbour that isn't looked up: RARE + its ending
SPAN = RARE + ENDINGS
#: Occurrences of rare words whose fits a task holds at once.
FITS = 1 << 15


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def tokens(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """A batch's lower-case words, and each one's class by its last three bytes."""
    words = Words([x.lower() for x in texts])
    h = np.zeros(len(words.word), np.uint64)
    for back in (1, 2, 3):
        byte = words.data[np.maximum(words.end - back, 0)].astype(np.uint64) + np.uint64(1)
        h = h * np.uint64(257) + np.where(words.end - back >= words.start, byte, 0).astype(np.uint64)
    return words, (mix(h) % np.uint64(ENDINGS)).astype(np.int64)


class Tally:
    """Counts by 64-bit key, merged as they come."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.held += len(k)
        if self.held > FLUSH:
            self._merge()

    def _merge(self) -> None:
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.keys, self.counts, self.held = [k], [np.bincount(at, np.concatenate(self.counts)).astype(np.int64)], len(k)

    def take(self, least: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
        """All counts, if more than `least` keys are held; the tally is empty then."""
        if self.held <= least:
            return None
        self._merge()
        if self.held <= least:
            return None
        out = self.keys[0], self.counts[0]
        self.__init__()
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, c) over all texts; the word is its hash."""

    def count(slices: Iterator) -> Iterator:
        tally = Tally()

        def out(found: tuple | None) -> Iterator:
            if found:
                yield None, None, {"word": found[0][:, 0], "ending": found[0][:, 1], "c": found[1]}

        seen: dict = {}
        for texts, _ in slices:
            words, ending = tokens(texts)
            tally.add(words.word)
            first = np.unique(words.word, return_index=True)
            seen[len(seen)] = (first[0], ending[first[1]].astype(np.uint8))
            if tally.held > FLUSH // 2 or len(seen) > 64:
                yield from out(_with_endings(tally, seen))
        yield from out(_with_endings(tally, seen))

    return mapped(docs, count, "word long, ending int, c long").groupBy("word").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


def _with_endings(tally: Tally, seen: dict) -> tuple[np.ndarray, np.ndarray] | None:
    found = tally.take()
    if found is None:
        return None
    words, endings = (np.concatenate([x[k] for x in seen.values()]) for k in (0, 1))
    seen.clear()
    known, at = np.unique(words, return_index=True)
    return np.stack([found[0].view(np.int64), endings[at][np.searchsorted(known, found[0])].astype(np.int64)], 1), found[1]


class Vocabulary:
    """Words with a class of their own, by sorted hash."""

    def __init__(self, words: np.ndarray, c: np.ndarray):
        order = np.argsort(words)
        self.words, self.c = words[order], c[order]
        self.kind = np.zeros(len(words), np.int16)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Each word's place here, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """(ids, rare): each text's words as 32-bit numbers, their place among the known, or -1 - ending, and the hashes of the latter; every pass of the clustering reads these."""
    shared = docs.sparkSession.sparkContext.broadcast(known.words)

    def encode(slices: Iterator) -> Iterator:
        known = Vocabulary(shared.value, shared.value)
        for texts, rows in slices:
            words, ending = tokens(texts)
            at = known.places(words.word)
            ids, rare = np.where(at >= 0, at, -1 - ending).astype("<i4").tobytes(), words.word[at < 0].tobytes()
            held = np.concatenate([[0], np.cumsum(at < 0)])[words.first].tolist()
            cut = lambda data, size, first: [data[size * a : size * b] for a, b in zip(first, first[1:])]
            yield rows, None, {"ids": cut(ids, 4, words.first.tolist()), "rare": cut(rare, 8, held)}

    return materialise(mapped(docs, encode, "ids binary, rare binary"))


def _sequence(texts: list[bytes], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (`of` each known word, endings of others) of a batch of encoded documents, with END around each; the words' numbers; and their places in it."""
    ids = np.frombuffer(b"".join(texts), "<i4")
    document = np.repeat(np.arange(len(texts)), [len(x) // 4 for x in texts])
    kinds, where = np.full(len(ids) + len(texts) + 1, END, np.int64), np.arange(len(ids)) + document + 1
    kinds[where] = np.where(ids >= 0, of[np.maximum(ids, 0)] if len(of) else 0, -1 - ids)
    return kinds, ids, where


def _contexts(kinds: np.ndarray, where: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """Of the rare words at `where` in a sequence of classes: the class before, the one after and the own ending, in one number."""
    around = kinds.copy()
    around[where] += RARE
    return ((around[where - 1] * SPAN + around[where + 1]) * ENDINGS + ending).astype(np.int32)


def _parts(context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    context = context.astype(np.int64)
    return context // (SPAN * ENDINGS), context // ENDINGS % SPAN, context % ENDINGS


def bigrams(docs: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """How often each class follows each, over all encoded texts: a table of `size` x `size`."""
    shared = docs.sparkSession.sparkContext.broadcast(of)

    def count(slices: Iterator) -> Iterator:
        total = np.zeros(size * size, np.int64)
        for texts, _ in slices:
            kinds = _sequence(texts, shared.value)[0]
            total += np.bincount(kinds[:-1] * size + kinds[1:], minlength=size * size)
        at = np.flatnonzero(total)
        yield None, None, {"k": at, "n": total[at]}

    out = np.zeros(size * size)
    found = mapped(docs, count, "k long, n long", text="ids").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # at most size x size
    out[found["k"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out.reshape(size, size)


def exchange(first: np.ndarray, second: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each clustered word (ordered by count), and the class bigram counts, by exchange clustering."""
    size = END + 1
    of = np.concatenate([np.arange(size), ENDINGS + np.arange(words) % CLASSES])
    total = np.zeros((size, size))
    np.add.at(total, (of[first], of[second]), n)
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    f_at, s_at = np.searchsorted(first[by_first], np.arange(size + words + 1)), np.searchsorted(second[by_second], np.arange(size + words + 1))
    movable = np.arange(ENDINGS, END)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(EXCHANGES):
        moved = 0
        for w in range(size, size + words):
            out, into = by_first[f_at[w] : f_at[w + 1]], by_second[s_at[w] : s_at[w + 1]]
            after = np.bincount(of[second[out]], n[out], size)
            before = np.bincount(of[first[into]], n[into], size)
            twice, a = n[out][second[out] == w].sum(), of[w]
            total[a] -= after
            total[:, a] -= before
            total[a, a] += twice
            after[a] -= twice
            before[a] -= twice
            rows, cols = total[movable], total[:, movable].T
            each = np.arange(len(movable))
            own = total[movable, movable]
            gain = (f(rows + after) - f(rows)).sum(1) + (f(cols + before) - f(cols)).sum(1)
            gain -= f(own + after[movable]) - f(own) + f(own + before[movable]) - f(own)
            gain += f(own + after[movable] + before[movable] + twice) - f(own)
            r, c, mass = rows.sum(1), cols.sum(1), after.sum() + twice
            gain -= f(r + mass) - f(r) + f(c + before.sum() + twice) - f(c)
            b = movable[each[np.argmax(gain)]] if gain.max() > gain[a - ENDINGS] + 1e-9 else a
            moved += b != a
            of[w] = b
            total[b] += after
            total[:, b] += before
            total[b, b] += twice
        if not moved:
            break
    return of[size:], total


def _fits(total: np.ndarray) -> np.ndarray:
    """What a class before a word, and a class after it, say of each class for the word."""
    prior = (total.sum(0) + 1) / (total.sum() + len(total))
    after = np.log((total + SMOOTH * prior) / (total.sum(1, keepdims=True) + SMOOTH))  # log P(next | class)
    return np.concatenate([after[:, ENDINGS:END], after[ENDINGS:END].T])


def assigned(docs: DataFrame, of: np.ndarray, fixed: np.ndarray, total: np.ndarray) -> np.ndarray:
    """One exchange step for every known word that isn't `fixed`, against the classes as they are (`of`, class bigrams `total`)."""
    size, spark = END + 1, docs.sparkSession
    shared = spark.sparkContext.broadcast((of, fixed))

    def contexts(slices: Iterator) -> Iterator:
        of, fixed = shared.value
        tally = Tally()
        for texts, _ in slices:
            kinds, ids, where = _sequence(texts, of)
            free = np.flatnonzero((ids >= 0) & ~fixed[np.maximum(ids, 0)])
            base = ids[free].astype(np.int64) * (2 * size)
            tally.add(np.concatenate([base + kinds[where[free] - 1], base + size + kinds[where[free] + 1]]))
            if (found := tally.take(FLUSH // 2)) is not None:
                yield None, None, {"k": found[0], "n": found[1]}
        if (found := tally.take()) is not None:
            yield None, None, {"k": found[0], "n": found[1]}

    summed = mapped(docs, contexts, "k long, n long", text="ids").groupBy("k").agg(F.sum("n").alias("n"))
    by_word = summed.groupBy(F.expr(f"k div {2 * size}").alias("w")).agg(F.collect_list((F.col("k") % (2 * size)).cast("int")).alias("code"), F.collect_list("n").alias("n"))  # at most 2 x size
    fits = spark.sparkContext.broadcast(_fits(total))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                code, n = part.column("code"), part.column("n")
                first = code.offsets.to_numpy() - code.offsets[0].as_py()
                values = fits.value[code.flatten().to_numpy(zero_copy_only=False)] * n.flatten().to_numpy(zero_copy_only=False)[:, None]
                best = np.add.reduceat(values, first[:-1], axis=0).argmax(1) + ENDINGS
                yield pa.RecordBatch.from_arrays([part.column("w"), pa.array(best.astype(np.int32))], ["w", "class"])

    out = of.copy()
    chosen = by_word.mapInArrow(choose, "w long, class int").toPandas()  # at most 1 / LOOKED_UP
    out[chosen["w"].to_numpy(np.int64)] = chosen["class"].to_numpy(np.int64)
    return out


def occurrences(docs: DataFrame, of: np.ndarray) -> DataFrame:
    """(word, next, context): every occurrence of a rare word in encoded texts, and the word after it if that is rare, else 0."""
    shared = docs.sparkSession.sparkContext.broadcast(of)

    def find(slices: Iterator) -> Iterator:
        for texts, rows in slices:
            kinds, ids, where = _sequence(texts, shared.value)
            rare = np.flatnonzero(ids < 0)
            word = np.frombuffer(b"".join(rows.column("rare").to_pylist()), "<i8")
            context = _contexts(kinds, where[rare], -1 - ids[rare].astype(np.int64))
            yield None, None, {"word": word, "next": np.where(_parts(context)[1] >= RARE, np.append(word[1:], 0)[: len(word)], 0), "context": context}

    return mapped(docs, find, "word long, next long, context int", text="ids", also=["rare"])


def _met(pairs: DataFrame, learned: DataFrame) -> DataFrame:
    """Neighbouring rare words (word, next, context), one of which has a learned class: their endings e1, e2 and classes k1, k2."""
    first, second = learned.select("word", F.col("class").alias("k1")), learned.select(F.col("word").alias("next"), F.col("class").alias("k2"))
    met = pairs.join(first.hint("shuffle_hash"), "word", "left").join(second.hint("shuffle_hash"), "next", "left").where("k1 is not null or k2 is not null")
    met = met.withColumns({"e1": F.expr(f"context % {ENDINGS}"), "e2": F.expr(f"cast(context div {ENDINGS} % {SPAN} - {RARE} as int)")})
    return met.withColumns({"k1": F.coalesce("k1", "e1"), "k2": F.coalesce("k2", "e2")})


def rare_classes(docs: DataFrame, of: np.ndarray, total: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, ending, class, c) of every rare word, by one exchange step for those that occur twice or more; and the class bigrams with them.

    A word's group has fewer occurrences than a word that is looked up.
    """
    size, spark = END + 1, docs.sparkSession
    found = occurrences(docs, of)
    fits = spark.sparkContext.broadcast(_fits(total))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.int64()), ("ending", pa.int32()), ("class", pa.int32()), ("c", pa.int64()), ("k", pa.int64()), ("n", pa.int64())])
        moved, ends = np.zeros(size * size, np.int64), fits.value
        for batch in batches:
            column = batch.column("contexts")
            first = column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()
            contexts, lo = column.flatten().to_numpy(), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + FITS, side="right")) - 1)
                before, after, ending = _parts(contexts[first[lo] : first[hi]])
                c = np.diff(first[lo : hi + 1])
                own = ending[first[lo:hi] - first[lo]]
                kind, again = own.copy(), np.repeat(c > 1, c)
                if again.any():
                    a, b = (np.where(x < RARE, x, x - RARE)[again] for x in (before, after))
                    begin = np.concatenate([[0], np.cumsum(c[c > 1])[:-1]])
                    kind[c > 1] = np.add.reduceat(ends[a] + ends[size + b], begin, axis=0).argmax(1) + ENDINGS
                k = np.repeat(kind, c)
                for new, old, edge in ((before * size + k, before * size + ending, before < RARE), (k * size + after, ending * size + after, after < RARE)):
                    moved += np.bincount(new[edge], minlength=size * size) - np.bincount(old[edge], minlength=size * size)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("word").slice(lo, hi - lo), pa.array(own.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(c), none, none], schema=schema)
                lo = hi
        at = np.flatnonzero(moved)
        none = [pa.nulls(len(at), f.type) for f in list(schema)[:4]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at), pa.array(moved[at])], schema=schema)

    by_word = found.groupBy("word").agg(F.collect_list("context").alias("contexts"))
    chosen = materialise(by_word.mapInArrow(choose, "word long, ending int, class int, c long, k long, n long"))
    words = chosen.where("class is not null").select("word", "ending", "class", "c")
    pairs = _met(found.where(f"context div {ENDINGS} % {SPAN} >= {RARE}"), words.where("c > 1"))
    both = F.array(F.struct((F.col("k1") * size + F.col("k2")).cast("long").alias("k"), F.lit(1).alias("n")), F.struct((F.col("e1") * size + F.col("e2")).cast("long").alias("k"), F.lit(-1).alias("n")))
    edges = pairs.select(F.inline(both)).union(chosen.where("class is null").select("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # at most size x size
    total = total.copy().reshape(-1)
    total[edges["k"].to_numpy(np.int64)] += edges["n"].to_numpy(np.float64)
    return words, total.reshape(size, size)


class Model:
    """What a task needs to score: bounded by the words that are looked up.  All others are in the table `rest`."""

    def __init__(self, counts: DataFrame, train: DataFrame):
        n_docs = train.count()
        totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.tokens, self.distinct, self.ends = totals[0] + n_docs, totals[1] + (n_docs > 0), n_docs
        self.cut = max(2.0, LOOKED_UP * self.tokens)
        found = counts.where(F.col("c") >= self.cut).select("word", "c", "ending").toPandas()  # at most 1 / LOOKED_UP
        words = found["word"].to_numpy(np.int64).view(np.uint64)
        self.known = known = Vocabulary(words, found["c"].to_numpy(np.float64))
        of, total = self.classes(train, found["ending"].to_numpy(np.int64)[np.argsort(words)])
        known.kind = of.astype(np.int16)
        self.of_class = np.bincount(of, known.c, END + 1)
        self.discount, self.kinds = np.full(ENDINGS, 0.5), np.zeros(ENDINGS)
        for r in self.rest.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect():  # at most END
            self.of_class[r["class"]] += r.n
            if r["class"] < ENDINGS:
                self.kinds[r["class"]] = r.v
                self.discount[r["class"]] = min(0.95, max(0.05, r.n1 / (r.n1 + 2 * r.n2)))
        self.mass, mass = self.of_class[:ENDINGS], total.sum(0)
        prior = (mass + 1) / (mass.sum() + len(mass))
        self.transition = np.log10((total + SMOOTH * prior) / (total.sum(1, keepdims=True) + SMOOTH))
        self.unknown = np.log10(np.where(self.mass > 0, self.discount * self.kinds / np.maximum(self.mass, 1), 1.0))
        self.emit = np.log10(known.c / self.of_class[of]) if len(of) else np.zeros(0)
        self.floor = np.log10(self.tokens + self.distinct + 1)
        self.base = np.log10(known.c + 1)
        self.learned = self.of_class[ENDINGS:].sum() / max(1, self.tokens)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rest"}

    def classes(self, train: DataFrame, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each known word, and the class bigrams; `rest` has the classes of all others."""
        known = self.known
        texts = encoded(train, known)
        core = np.lexsort((known.words, -known.c))[:CORE]
        fixed = np.zeros(len(known.words), bool)
        fixed[core] = True
        of = ending.copy()  # words without a class count by their ending
        of[core] = END + 1 + np.arange(len(core))
        table_ = bigrams(texts, of, END + 1 + len(core))
        first, second = np.nonzero(table_)
        of[core], total = exchange(first, second, table_[first, second], len(core))
        for _ in range(SWEEPS if len(known.words) > len(core) else 0):
            of = assigned(texts, of, fixed, total)
            total = bigrams(texts, of, END + 1)
        self.rest, total = rare_classes(texts, of, total)
        return of, total

    def local(self, texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """The words, the places of rare ones, their contexts, and each text's figures as if its rare words were unknown."""
        words, ending = tokens(texts)
        at = self.known.places(words.word)
        seen = at >= 0
        kind = np.where(seen, self.known.kind[at] if len(self.known.words) else 0, ending).astype(np.int64)
        kinds = np.full(len(at) + len(texts) + 1, END, np.int64)
        where, missing = np.arange(len(at)) + words.document + 1, np.flatnonzero(~seen)
        kinds[where] = kind
        owner = np.searchsorted(words.first[1:] + np.arange(1, len(texts) + 1), np.arange(len(kinds) - 1), side="right")
        steps = np.bincount(owner, self.transition[kinds[:-1], kinds[1:]], len(texts))
        number = lambda known, other: np.bincount(words.document, np.where(seen, known[at] if len(known) else 0.0, other), len(texts))
        n = np.diff(words.first)
        return words, missing, _contexts(kinds, where[missing], ending[missing]), {
            "n_tokens": n + 1,
            "local_known": np.bincount(words.document, seen, len(texts)).astype(np.int64) + (self.ends > 0),
            "local_base": number(self.base, 0.0) + np.log10(self.ends + 1) - self.floor * (n + 1),
            "local_score": steps + number(self.emit, self.unknown[ending]),
        }


def scored(docs: DataFrame) -> DataFrame:
    """Every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), and the score's perplexity."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("text_hash", F.xxhash64("text"))
    train = docs.where(~held_out(F.col("doc_id"))).select("text")
    counts = materialise(word_counts(train))
    model = Model(counts, train)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score_(slices: Iterator) -> Iterator:
        for texts, rows in slices:
            words, missing, context, figures = shared.value.local(texts)
            w, d = words.word[missing], words.document[missing]
            after = np.where(_parts(context)[1] >= RARE, np.append(w[1:], np.uint64(0))[: len(w)], np.uint64(0))
            order = np.lexsort((after, context, w, d))
            w, d, after, context = w[order], d[order], after[order], context[order]
            new = [x[1:] != x[:-1] for x in (w, d, after, context)]
            first = np.flatnonzero(np.concatenate([[True], np.any(new, axis=0)])) if len(w) else np.zeros(0, np.int64)
            begin = np.searchsorted(d[first], np.arange(len(texts) + 1))
            held = {"rare": w.view(np.int64)[first], "next": after.view(np.int64)[first], "context": context[first], "times": np.diff(np.append(first, len(w))).astype(np.int32)}
            yield rows, None, {**figures, **{c: lists(x, begin) for c, x in held.items()}}

    key = ["doc_id", "text_hash"]
    figures = "n_tokens long, local_known long, local_base double, local_score double"
    copies = materialise(mapped(docs, score_, f"{figures}, rare array<long>, next array<long>, context array<int>, times array<int>", key))
    steps = np.zeros((SPAN, SPAN))  # edges to rare neighbours are looked at apart
    steps[: END + 1, : END + 1] = model.transition
    step = docs.sparkSession.sparkContext.broadcast(steps)

    @F.pandas_udf("double")
    def moved(context: pd.Series, kind: pd.Series) -> pd.Series:
        """What the steps around a rare word gain by its class."""
        (a, b, e), k, t = _parts(context.to_numpy()), kind.to_numpy(), step.value
        return pd.Series(t[a, k] - t[a, e] + t[k, b] - t[e, b])

    @F.pandas_udf("double")
    def between(k1: pd.Series, k2: pd.Series, e1: pd.Series, e2: pd.Series) -> pd.Series:
        t = step.value
        return pd.Series(t[k1.to_numpy(), k2.to_numpy()] - t[e1.to_numpy(), e2.to_numpy()])

    number = lambda x, of: F.element_at(F.array(*map(F.lit, x.tolist())), F.col(of) + 1)
    once = F.log10(F.col("c") - number(model.discount, "ending")) - F.log10(number(model.discount * np.maximum(model.kinds, 1), "ending"))
    learned = F.log10(F.col("c") / number(model.of_class, "class")) - number(model.unknown, "ending")
    seen = model.rest.select("word", "class", F.log10(F.col("c") + 1).alias("b"), F.when(F.col("class") < ENDINGS, once).otherwise(learned).alias("s"))
    rare = copies.select(*key, F.explode(F.arrays_zip("rare", "next", "context", "times")).alias("x")).select(
        *key, F.col("x.rare").alias("word"), F.col("x.next").alias("next"), F.col("x.context").alias("context"), F.col("x.times").alias("n")
    )
    alone = rare.drop("next").join(seen.hint("shuffle_hash"), "word")
    alone = alone.select(*key, "n", (F.col("n") * F.col("b")).alias("b"), (F.col("n") * (F.col("s") + moved("context", "class"))).alias("s"))
    pairs = _met(rare.where(f"context div {ENDINGS} % {SPAN} >= {RARE}"), model.rest.where("c > 1"))
    pairs = pairs.select(*key, F.lit(0).alias("n"), F.lit(0.0).alias("b"), (F.col("n") * between("k1", "k2", "e1", "e2")).alias("s"))
    more = alone.union(pairs).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    many = copies.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1")
    same = F.expr("doc_id <=> d and text_hash <=> h")
    out = copies.join(more.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), same, "left").drop("d", "h")
    out = out.join(many.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), same, "left")
    share = lambda c: F.coalesce(F.col(c) / F.coalesce("copies", F.lit(1)), F.lit(0.0))
    score = F.col("local_score") + share("s")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("local_known") + share("n").cast("long")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("local_base") + share("b")).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
