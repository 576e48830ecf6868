"""Toxicity by noisy-channel restoration.

A character trigram model, counted over all documents, is the language model.  A word
that looks disguised (symbols or digits among its letters, letters repeated), or a stretch
of letters that stand alone, becomes a lattice: each symbol may stand for the letters it
resembles, a separator for nothing, a space for nothing or for the border of two words, a
run of one letter for one or two of it, each at a channel cost.  Viterbi takes the likeliest
spelling.  Restored words and their beginnings are weighed by naive Bayes, learned from
labelled documents: telling words add their log-odds, every other word takes a little off.

The label model is fitted on at most `TRAIN_ROWS` labelled training rows, chosen by
hash; the language model and the scores cover every whole text.

Defined results: null and empty texts score the share of toxic rows; repeated rows score
alike; a null doc_id is held out; labels rows that are null or contradict each other (both
values for one doc_id) are not learned from; of spellings that tie the one found first is
taken, and a score equal to the threshold counts as toxic; other columns, whatever their
names, come back in `row`; an empty table gives no rows; texts are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import mapped, materialise, table

#: Labelled rows the label model is fitted on, at most.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
#: Toxic training documents a telling feature needs, the least log-odds it needs, and clean words its prior counts for.
LEAST_DOCS, LEAST_WEIGHT, PRIOR = 3, 3.0, 2.0
#: Toxic texts are expected to hold this many times fewer telling words than the training rows' average.
THIN = 2.0
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Restored words a worker remembers.
CACHE = 500_000

# What a symbol may stand for: fixed values.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = ".-_*'’~^"
#: Channel costs (log10): a look-alike, a dropped separator, a letter behind an asterisk, a shortened run, a dropped space.
LOOK, DROP, HIDDEN, SHORTEN, JOIN = -1.0, -0.5, -2.5, -0.3, -0.2

_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_CODE = {c: k + 1 for k, c in enumerate(_LETTERS)}
_OTHER, _SIZE = 62, 64
_TABLE = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _TABLE[_c] = _CODE.get(chr(_c).lower(), _OTHER if chr(_c).isalpha() else 0)

_EDGES = re.compile(r"^[^\w@$!|+€£]+|[\W_]+$")
_NOISY = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|^[\d@$!|+€£]+[^\W\d_]|([^\W\d_])\1\1|[^\W\d_]\d+$")
_SPELLED = re.compile(r"(?<!\S)[\w@$!|+€£](?:[ ._\-]+[\w@$!|+€£]){2,}(?!\w)")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def character_model(docs: DataFrame) -> np.ndarray:
    """log10 P(c | a, b) by interpolated trigrams, counted over all texts; 64 codes, so its size is fixed."""

    def count(slices: Iterator) -> Iterator:
        total = np.zeros(_SIZE**3, np.int64)
        for texts, _ in slices:
            for text in filter(None, texts):
                code = np.frombuffer(f"  {text.decode('utf-8', 'replace')} ".encode("utf-32-le", "replace"), np.uint32)
                code = np.where(code < 0x250, _TABLE[np.minimum(code, 0x24F)], _OTHER)
                total += np.bincount((code[:-2] * _SIZE + code[1:-1]) * _SIZE + code[2:], minlength=_SIZE**3)
        at = np.flatnonzero(total)
        yield None, None, {"k": at, "n": total[at]}

    c = np.zeros(_SIZE**3)
    for r in mapped(docs, count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        c[r.k] = r.n
    c = c.reshape(_SIZE, _SIZE, _SIZE)
    two, one = c.sum(0), c.sum((0, 1))
    p1 = (one + 1) / (one.sum() + _SIZE)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log10((c + 5 * p2) / (c.sum(2, keepdims=True) + 5))


class Restorer:
    """Viterbi decoding of one word's lattice."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def edges(self, word: str, i: int) -> Iterator[tuple[int, str, float]]:
        """(next place, letters written, channel cost) from place i."""
        c = word[i]
        if c.isalpha():
            n = 1
            while i + n < len(word) and word[i + n] == c:
                n += 1
            if n == 1:
                yield i + 1, c, 0.0
            else:
                yield i + n, c, SHORTEN
                yield i + n, c + c, 0.0 if n == 2 else SHORTEN
            return
        if c == " ":
            yield i + 1, " ", 0.0
            yield i + 1, "", JOIN
            return
        for x in LOOKS_LIKE.get(c, ""):
            yield i + 1, x, LOOK
        if c == "*":
            for x in _LETTERS[:26]:
                yield i + 1, x, HIDDEN
        yield i + 1, "", DROP if c in SEPARATORS else DROP - 1.0

    def __call__(self, word: str) -> str:
        model, code = self.model, _CODE.get
        ahead: list[dict] = [{} for _ in range(len(word) + 1)]  # by place: (last two codes) -> (score, letters)
        ahead[0][0, 0] = (0.0, "")
        for i in range(len(word)):
            if not ahead[i]:
                continue
            edges = list(self.edges(word, i))
            for (a, b), (score, text) in ahead[i].items():
                for to, letters, cost in edges:
                    s, x, y = score + cost, a, b
                    for c in letters:
                        k = 0 if c == " " else code(c, _OTHER)
                        s += model[x][y][k]
                        x, y = y, k
                    old = ahead[to].get((x, y))
                    if old is None or s > old[0]:
                        ahead[to][x, y] = (s, text + letters)
            ahead[i] = {}
        return max(((s + model[x][y][0], t) for (x, y), (s, t) in ahead[-1].items()), default=(0, ""))[1]


def words(text: str) -> set[str]:
    """Distinct lower-case words, and stretches of characters that stand alone."""
    text = text.lower()
    return {*text.split(), *_SPELLED.findall(text)}


def restored(word: str, restore: Restorer) -> str:
    """The likeliest spelling of a word, or the words of a stretch."""
    if " " in word:
        return restore(word)
    core = word if word.isalpha() else _EDGES.sub("", word)
    return restore(core) if _NOISY.search(core) else core


def features(spelling: str) -> list[str]:
    """Each word itself and its beginnings."""
    return [f for word in spelling.split() if len(word) > 2 for f in (word, *(f"{word[:n]}^" for n in PREFIXES if len(word) > n))]


class Lexicon(dict):
    """From a raw word to the weight of its most telling feature, or None."""

    def __init__(self, fitted: Fitted, restore: Restorer):
        self.fitted, self.restore = fitted, restore

    def __missing__(self, word: str) -> float | None:
        if len(self) > CACHE:
            self.clear()
        weights = self.fitted.weights
        self[word] = best = max((weights[f] for f in features(restored(word, self.restore)) if f in weights), default=None)
        return best

    def log_odds(self, text: str) -> tuple[float, int]:
        """The text's log-odds of being toxic, and its distinct telling words."""
        found = words(text)
        told = [w for w in map(self.__getitem__, found) if w is not None]
        return self.fitted.prior + sum(told) - self.fitted.other * (len(found) - len(told)), len(told)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text of at most TRAIN_ROWS labelled rows outside the held-out fold."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("other")).where("toxic = other")
        .orderBy(F.xxhash64("doc_id")).limit(TRAIN_ROWS).select("doc_id", "toxic")
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


class Fitted:
    """The label model: the log-odds of telling features, what every other word takes off, and the log-odds of a toxic row."""

    def __init__(self, weights: dict[str, float], rate: float, share: float):
        self.weights = {f: w - math.log(THIN) for f, w in weights.items()}
        self.other = rate / THIN
        self.prior = math.log(share / (1 - share))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Fitted]:
    """The character model, and the label model by naive Bayes over the distinct words of the training rows."""
    model = character_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = materialise(training_rows(docs, labels))

    def count(slices: Iterator) -> Iterator:
        restore, seen = Restorer(shared.value), {}
        for texts, labelled in slices:
            total: dict[tuple, list[int]] = {}
            for text, toxic in zip(texts, labelled.column("toxic").to_pylist()):
                found: Counter = Counter()
                for w in words(text.decode("utf-8", "replace")):
                    if w not in seen:
                        seen[w] = features(restored(w, restore))
                    found.update(seen[w])
                    found[""] += 1  # all words
                for f, n in found.items():
                    both = total.setdefault((f, toxic), [0, 0])
                    both[0] += n
                    both[1] += 1
            if len(seen) > CACHE:
                seen.clear()
            yield None, None, {"feature": [f for f, _ in total], "toxic": [t for _, t in total], "n": [n for n, _ in total.values()], "docs": [d for _, d in total.values()]}

    of = lambda c, toxic: F.sum(F.when(F.col("toxic") == toxic, F.col(c)).otherwise(0))
    counts = materialise(
        mapped(rows, count, "feature string, toxic int, n long, docs long", also=["toxic"]).groupBy("feature")
        .agg(of("n", 1).alias("t"), of("n", 0).alias("c"), of("docs", 1).alias("docs"), F.sum("docs").alias("all"))
    )
    every = counts.where("feature = ''").first()
    toxic, clean, docs_toxic, docs_all = (every.t, every.c, every.docs, every["all"]) if every else (0, 0, 0, 0)
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + PRIOR) / (clean + 2 * PRIOR))
    chosen = counts.where((F.col("docs") >= LEAST_DOCS) & (F.col("feature") != "")).select("feature", weight.alias("w")).where(F.col("w") >= LEAST_WEIGHT)
    fitted = Fitted({r.feature: r.w for r in chosen.collect()}, 0.0, (docs_toxic + 0.5) / (docs_all + 5))  # bounded by the training rows' words
    told = score_totals(rows.where("toxic = 1"), model, fitted).agg(F.sum("told")).first()[0] or 0
    fitted.other = told / max(1, toxic) / THIN
    return model, fitted


def score_totals(docs: DataFrame, model: np.ndarray, fitted: Fitted) -> DataFrame:
    """Every row as a struct `row`, its log_odds, and `told` (its distinct telling words)."""
    shared = docs.sparkSession.sparkContext.broadcast((model, fitted))

    def score(slices: Iterator) -> Iterator:
        lexicon = Lexicon(shared.value[1], Restorer(shared.value[0]))
        for texts, rows in slices:
            found = [lexicon.log_odds(x.decode("utf-8", "replace")) for x in texts]
            yield rows, None, {"log_odds": [float(x) for x, _ in found], "told": [n for _, n in found]}

    return mapped(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text"), score, "log_odds double, told long", ["row"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row as a struct `row`, and its score, from 0 to 1."""
    scored = score_totals(docs, *fit(docs.select("doc_id", "text"), labels))
    return scored.select("row", (1 / (1 + F.exp(-F.greatest(F.least("log_odds", F.lit(60.0)), F.lit(-60.0))))).alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
