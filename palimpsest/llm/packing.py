"""Best-fit packing of tokenised documents by patterns fitted with non-negative least squares.

1. `tokenised` turns every text into token pieces, of which only lengths and a CRC leave the task.
2. The histogram of piece lengths (at most `capacity` counts, whatever the corpus) is the only thing
   the plan is made from.  `by_patterns` enumerates patterns of one to four length classes that fill
   a sequence, fits their repeat counts to the histogram by non-negative least squares (active sets,
   so few patterns repeat often), and rounds them by largest remainder.  The residuals, which are most
   of the short pieces, are packed best-fit, longest first, into the gaps and then into new sequences.
   Runs of equal pieces are handled at once, so the work depends on the number of lengths only.
3. `assign` numbers the pieces of one length (salted, so that a hot length is many groups) and looks
   each number up in the plan: a piece finds its sequence and offset without meeting other pieces.

Defined results: null or empty text is the one end token; repeated rows are packed separately;
pieces of equal length are interchangeable, so ties fall by (doc_id, piece, ids); a null doc_id
stays null; other columns are ignored; an empty table gives no rows; a text of any length is cut
after tokenising, never before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import mapped, materialise, table

CAPACITY = 4096
END = 1
#: Width of a length class in the fit, and most documents of a pattern.
GRAIN, DOCUMENTS = 32, 4
#: Pieces shorter than this part of a sequence stay out of the patterns: they fill the gaps that rounding lengths up leaves.
FILLERS = 16
#: Distinct words whose ids a worker remembers.
CACHE = 1_000_000

# The tokenizer's own splitting rule, for texts in which it needs no Unicode normalisation: fixed values.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\t-\\r {_LETTER}{_NUMBER}]+")
_UNUSUAL = re.compile("[^\\t-\\r -~¡-įı-ɏ‐-―‘-‟…€]|<\\|")


#: Byte-level BPE writes every byte as a printable character: these bytes as themselves, the others from 256 on, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_PRINTABLE = {byte: 256 + k for k, byte in enumerate(x for x in range(256) if x not in _PLAIN)}


class Encoder(dict):
    """Token ids as little-endian 32-bit bytes, by blank-separated word; words already seen are looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        units = [word] if word.isalpha() else _UNIT.findall(word)
        ids = [t.id for u in units for t in self.merge(u if u.isascii() else u.encode().decode("latin-1").translate(_PRINTABLE))]
        self[word] = out = np.array(ids, "<u4").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        if _UNUSUAL.search(text):  # needs normalisation, or might name a special token
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32; the end token closes each document's last piece."""

    def pieces(slices: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end, step = Encoder(tokenizer_path), np.array([END], "<u4").tobytes(), 4 * capacity
        for texts, rows in slices:
            at, found = [], []
            for i, text in enumerate(texts):
                ids = (encode.ids(text.decode("utf-8", "replace")) if text else b"") + end
                for k, begin in enumerate(range(0, len(ids), step)):
                    part = ids[begin : begin + step]
                    at.append(i)
                    found.append((k, begin // 4, len(part) // 4, zlib.crc32(part)))
            yield rows, at, dict(zip(("piece", "start", "length", "ids_crc32"), map(list, zip(*found))))

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), pieces, "piece int, start long, length long, ids_crc32 long", ["doc_id"])


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The non-negative x with the least |a x - b|, by active sets (Lawson and Hanson): at most one positive entry a row of `a`."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    least = 1e-3 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(3 * a.shape[0] + 10):
        candidates = np.where(used, -np.inf, gradient)
        if used.all() or candidates.max() <= least:
            break
        used[np.argmax(candidates)] = True
        while True:
            at = np.flatnonzero(used)
            part = a[:, at]
            best = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(at)), part.T @ b)
            low = best <= 1e-12
            if not low.any():
                break
            step = np.min(x[at][low] / np.maximum(x[at][low] - best[low], 1e-300))
            x[at] += step * (best - x[at])
            gone = at[low & (x[at] <= 1e-12)]
            x[gone], used[gone] = 0, False
        x[:] = 0
        x[at] = best
        gradient = a.T @ (b - a @ x)
    return x


def patterns(have: list[int], total: int, most: int) -> list[tuple[int, ...]]:
    """Up to `most` of the classes that are there (rounded-up lengths in grains), longest first, that together fill a sequence exactly."""
    out: list[tuple[int, ...]] = []

    def grow(taken: tuple[int, ...], left: int, top: int) -> None:
        if left == 0:
            out.append(taken)
        elif len(taken) < most:
            for k in have:  # longest first
                if k <= min(left, top) and k * (most - len(taken)) >= left:
                    grow((*taken, k), left - k, k)

    grow((), total, total)
    return out


def rounded(fitted: np.ndarray, columns: list[tuple[int, ...]], have: np.ndarray) -> np.ndarray:
    """Whole repeats: rounded down, then one more by largest remainder, as far as the classes' stock goes."""
    left, repeats = have.astype(np.int64), np.zeros(len(columns), np.int64)
    use = [np.array([(k, p.count(k)) for k in sorted(set(p))]) for p in columns]
    whole = np.floor(fitted + 1e-9)
    for more, order in ((whole, np.argsort(-fitted, kind="stable")), (np.ones(len(columns)), np.argsort(whole - fitted, kind="stable"))):
        for j in order:
            if fitted[j] > 1e-6:
                k, m = use[j].T
                n = min(int(more[j]), int((left[k] // m).min()))
                repeats[j] += n
                left[k] -= n * m
    return repeats


Groups = list[tuple[int, list[tuple[int, int]]]]


def by_patterns(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> tuple[Groups, list[list[int]]]:
    """Sequences by fitted patterns, as (repeats, [(length, how many of it in each)]), and the runs [length, count] left over.

    Full pieces are neither; pieces shorter than `capacity` / FILLERS are all left over, to fill gaps with.
    A pattern takes the longest pieces of its classes, and for its last place the longest that fits,
    be it of a longer class.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c if n < capacity else 0
    fitting = np.where(np.arange(capacity + 1) * FILLERS >= capacity, left, 0)
    classes = -(-capacity // grain)
    have = np.bincount(-(-np.arange(capacity + 1) // grain), fitting, classes + 1)
    columns = patterns([k for k in range(classes, 0, -1) if have[k]], capacity // grain, DOCUMENTS)
    groups: Groups = []
    if columns:
        a = np.zeros((classes + 1, len(columns)))
        for j, p in enumerate(columns):
            np.add.at(a[:, j], list(p), 1)
        scale = 1 / np.sqrt(np.maximum(have, 1))  # classes count alike, whatever their size
        repeats = rounded(nnls(a * scale[:, None], have * scale), columns, have)
        for j in np.argsort(-repeats, kind="stable"):
            wanted = int(repeats[j])
            while wanted > 0:  # runs of equal lengths at once
                parts: dict[int, int] = {}
                room = capacity
                for at, k in enumerate(columns[j]):
                    top = room if at + 1 == len(columns[j]) else min(room, k * grain)
                    length = next((x for x in range(top, (k - 1) * grain, -1) if fitting[x] > parts.get(x, 0)), 0)
                    if not length:
                        break
                    parts[length] = parts.get(length, 0) + 1
                    room -= length
                else:
                    n = min(wanted, *(int(fitting[x]) // m for x, m in parts.items()))
                    groups.append((n, list(parts.items())))
                    for x, m in parts.items():
                        fitting[x] -= n * m
                        left[x] -= n * m
                    wanted -= n
                    continue
                break  # longer classes' last places took these pieces
    return groups, [[n, int(left[n])] for n in range(capacity, 0, -1) if left[n]]


def pattern_share(histogram: dict[int, int], capacity: int = CAPACITY) -> float:
    """The share of the tokens outside full pieces that fitted patterns place."""
    placed = sum(n * m * x for n, parts in by_patterns(histogram, capacity)[0] for x, m in parts)
    return placed / max(1, sum(n * c for n, c in histogram.items() if n != capacity))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> Groups:
    """Sequences as (repeats, [(length, how many of it in each)]), covering the histogram exactly."""
    groups, rest = by_patterns(histogram, capacity, grain)
    full = histogram.get(capacity, 0)
    return [(full, [(capacity, 1)])] * (full > 0) + _best_fit(groups, rest, capacity)


def _best_fit(groups: Groups, rest: list[list[int]], capacity: int) -> Groups:
    """Pack runs of equal pieces, longest first, each into the fullest sequences with room; then open new ones."""
    rooms: dict[int, list[tuple[int, list]]] = {}
    for n, parts in groups:
        rooms.setdefault(capacity - sum(x * m for x, m in parts), []).append((n, parts))
    for length, count in rest:
        for room in sorted(r for r in rooms if r >= length):
            while count and rooms[room]:
                n, parts = rooms[room].pop()
                each = min(room // length, count)
                use = min(n, count // each)
                if use < n:
                    rooms[room].append((n - use, parts))
                rooms.setdefault(room - each * length, []).append((use, [*parts, (length, each)]))
                count -= use * each
            if not rooms[room]:
                del rooms[room]
            if not count:
                break
        each = capacity // length
        if count // each:
            rooms.setdefault(capacity - each * length, []).append((count // each, [(length, each)]))
        if count % each:
            rooms.setdefault(capacity - count % each * length, []).append((1, [(length, count % each)]))
    return [g for r in sorted(rooms) for g in rooms[r]]


def assign(pieces: DataFrame, groups: list[tuple[int, list[tuple[int, int]]]]) -> DataFrame:
    """Each piece's sequence and offset: the i-th piece of a length takes the plan's i-th place for that length.

    Pieces of one length are numbered in salted groups, whose sizes are summed first.
    """
    salts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("inside", F.row_number().over(inside) - 1).join(sizes, ["length", "salt"]).withColumn("number", F.col("inside") + F.col("before"))

    place: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first number, repeats times many, first sequence, many, offset
    first, taken = 0, {}
    for n, parts in groups:
        offset = 0
        for length, m in parts:
            place.setdefault(length, []).append((taken.get(length, 0), first, m, offset))
            taken[length] = taken.get(length, 0) + n * m
            offset += length * m
        first += n
    shared = pieces.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in place.items()})

    out = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                plan_rows, number = shared.value[length], numbers[rows]
                begun, first, m, at = plan_rows[np.searchsorted(plan_rows[:, 0], number, side="right") - 1].T
                sequence[rows], offset[rows] = first + (number - begun) // m, at + (number - begun) % m * length
            kept = [batch.column(c) for c in batch.schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return out.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed pieces of all documents."""
    pieces = materialise(tokenised(docs, tokenizer_path, capacity))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return assign(pieces, plan(histogram, capacity))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file())
