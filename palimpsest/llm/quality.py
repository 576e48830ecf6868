"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two bags of hashed words and word pairs are counted: one over all documents (raw), one over
documents labelled good (target).  A document's log weight is the log ratio of the target's
to the raw model's probability of its n-grams.  Adding Gumbel noise, fixed by the document,
and keeping the k largest draws k documents without replacement in proportion to their
weights.  k is the share of good documents among the labelled ones.

The target is fitted on at most `TARGET_ROWS` labelled rows, chosen by hash; raw counts and
weights cover every whole text.  The k-th largest value is found by a radix search over the
values' bits, a bounded histogram a round, so nothing is sorted or collected.

Defined results: null and empty texts have weight 0; values are compared in steps of 2^-20, and
documents that tie with the k-th in these are all kept; repeated rows draw alike; without labels
everything is kept; a null doc_id draws by its text; other columns are ignored; an empty table
gives no rows; texts of any length are weighed whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import mapped, materialise, mix, table

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
#: Tokens whose hash a worker remembers.
CACHE = 500_000
#: Added to each bucket's count, as a share of its count in the raw model.
SMOOTH = 0.5
RADIX = 12

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hasher(dict):
    """Buckets of a text's words and word pairs; case is kept."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[token] = h = zlib.crc32(token.encode("utf-8", "replace"))
        return h

    def buckets(self, text: str) -> np.ndarray:
        one = mix(np.array(list(map(self.__getitem__, _TOKEN.findall(text))), np.uint64))
        two = mix(one[:-1] * np.uint64(3) + one[1:])
        return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """n-grams by bucket over all texts."""

    def count(slices: Iterator) -> Iterator:
        total, hasher = np.zeros(BUCKETS, np.int64), Hasher()
        for texts, _ in slices:
            for text in filter(None, texts):
                total += np.bincount(hasher.buckets(text.decode("utf-8", "replace")), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield None, None, {"k": at, "n": total[at]}

    out = np.zeros(BUCKETS)
    for r in mapped(docs, count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.k] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket, the target shrunk towards the raw model."""
    p = (raw + 1) / (raw.sum() + len(raw))
    strength = SMOOTH * len(raw)
    return np.log((target + strength * p) / (target.sum() + strength)) - np.log(p)


def weighted(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight, and drawn: log_weight with Gumbel noise."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(slices: Iterator) -> Iterator:
        hasher = Hasher()
        for texts, rows in slices:
            yield rows, None, {"log_weight": [float(shared.value[hasher.buckets(x.decode("utf-8", "replace"))].sum()) if x else 0.0 for x in texts]}

    uniform = (F.pmod(F.xxhash64(F.coalesce("doc_id", "text_hash"), F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    out = mapped(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), weigh, "log_weight double", ["doc_id", "text_hash"])
    return out.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("drawn"))


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column, exactly: RADIX bits of its ordered form a round."""
    number = F.expr(f"cast(round({column} * 1048576) as bigint)")
    ordered = values.select((number + F.lit(1 << 62)).alias("v"))
    prefix, left = 0, k
    for shift in range(63 - 63 % RADIX, -1, -RADIX):
        bits = F.shiftrightunsigned("v", shift)
        rows = ordered.where(F.shiftrightunsigned("v", shift + RADIX) == prefix) if shift + RADIX < 64 else ordered
        counts = sorted(((r.b, r["count"]) for r in rows.groupBy(bits.alias("b")).count().collect()), reverse=True)  # at most 2^RADIX
        for b, n in counts:
            if left <= n:
                prefix = b
                break
            left -= n
        else:
            return None
    return (prefix - (1 << 62)) / 1048576


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept rows: doc_id, log_weight, drawn."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = good.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good")).first()
    target = good.where("quality = 1").orderBy(F.xxhash64("doc_id")).limit(TARGET_ROWS).select("doc_id")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    raw = bucket_counts(docs)
    wanted = bucket_counts(docs.join(F.broadcast(target), "doc_id"))
    scored = materialise(weighted(docs, log_ratio(wanted, raw)))
    k = round(scored.count() * sizes.good / sizes.n) if sizes.n else scored.count()
    least = kth_largest(scored, "drawn", k) if k else None
    kept = F.lit(False) if not k else F.lit(True) if least is None else F.expr("cast(round(drawn * 1048576) as bigint)") >= round(least * 1048576)
    return scored.where(kept)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "drawn", F.lit(True).alias("kept"))
