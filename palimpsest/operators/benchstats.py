"""Computations over benchmark runs: checksums, quantiles, bootstrap intervals, verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.errors import UnknownMetric

# Verdict bounds and the latency histogram's limits in microseconds: fixed values.
WIN, LOSS = 1.05, 0.95
SHORTEST, LONGEST = 1, 60_000_000
# FNV-1a, 64 bits, and the sampled items of the scrambled generator: fixed values.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
ITEMS, THETA, ZETA = 10_000_000_000, 0.99, 26.46902820178302


def checksum(rows: DataFrame) -> DataFrame:
    """n and the XOR of first(key) | first(value) << 8 over all rows."""
    first = lambda c: F.coalesce(F.ascii(F.substring(c, 1, 1)), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(first("key") + F.shiftleft(first("value"), 8)), F.lit(0)).alias("checksum"))


def latency_quantiles(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Per group: n, min, mean, max and quantiles of the value clamped to the histogram's limits."""
    clamped = F.greatest(F.least(F.col(value), F.lit(float(LONGEST))), F.lit(float(SHORTEST)))
    rows = samples.select(by, clamped.alias("x"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), *(F.percentile("x", q).alias(f"p{n}") for n, q in (("50", 0.5), ("90", 0.9), ("99", 0.99))))


def throughput(ops: Column, elapsed_ns: Column) -> Column:
    return ops * 1e9 / elapsed_ns


def verdict(low: Column, high: Column) -> Column:
    return F.when(low >= WIN, "Win").when(high <= LOSS, "Loss").otherwise("Tie")


def gate(metrics: DataFrame, known: list[str] | None = None) -> DataFrame:
    """wins, losses, ties, incomplete, passed over (metric, verdict): a null verdict is incomplete.

    With a column `fairness`, asymmetric metrics are left out and counted as skipped; with `known`,
    any other metric is an error.
    """
    if known is not None and not metrics.where(~F.col("metric").isin(known)).isEmpty():
        raise UnknownMetric("a metric is none of those to be graded")
    if "fairness" in metrics.columns:
        uneven = F.coalesce(F.col("fairness") == "asymmetric", F.lit(False))
        return gate(metrics.where(~uneven).drop("fairness")).crossJoin(metrics.agg(F.count_if(uneven).alias("skipped")))  # one row by one row
    n = lambda v: F.count_if(F.col("verdict") == v)
    counts = metrics.agg(n("Win").alias("wins"), n("Loss").alias("losses"), n("Tie").alias("ties"), F.count_if(F.col("verdict").isNull()).alias("incomplete"))
    return counts.withColumn("passed", (F.col("wins") >= 1) & (F.col("losses") == 0) & (F.col("incomplete") == 0))


def bootstrap(pairs: DataFrame, resamples: int = 10_000) -> DataFrame:
    """Per metric (ours, theirs per run, lower_is_better): mean ratio and its 95 % interval by paired resampling.

    Every run is drawn a Poisson number of times in each resample, which is resampling with
    replacement for many runs and needs no group in one place: a task draws for its rows and hands
    on a weight and a sum for each metric and resample.  Equal runs draw alike at every partitioning.
    """
    ratio = F.when(F.col("lower_is_better"), F.col("theirs") / F.col("ours")).otherwise(F.col("ours") / F.col("theirs"))
    counts = pairs.select("metric", ratio.alias("r")).groupBy("metric", "r").agg(F.count("*").alias("n"))
    seeded = counts.withColumn("seed", F.xxhash64("metric", "r"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, total = {}, {}
        for batch in batches:
            for metric, r, n, seed in batch.itertuples(index=False):
                drawn = np.random.default_rng(seed & 2**63 - 1).poisson(n, resamples)
                weight[metric] = weight.get(metric, 0) + drawn
                total[metric] = total.get(metric, 0) + drawn * r
        for metric in weight:
            yield pd.DataFrame({"metric": metric, "i": np.arange(resamples), "w": weight[metric], "s": total[metric]})

    sums = seeded.mapInPandas(draw, "metric string, i int, w long, s double").groupBy("metric", "i").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).where("w > 0")
    means = sums.groupBy("metric").agg(F.array_sort(F.collect_list(F.col("s") / F.col("w"))).alias("m"))  # `resamples` a metric
    at = lambda q: F.element_at("m", (F.floor(q * (F.size("m") - 1)) + 1).cast("int"))
    mean = counts.groupBy("metric").agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("ratio"))
    return mean.join(means, "metric").select("metric", "ratio", at(0.025).alias("low"), at(0.975).alias("high"))


def fnv1a(x: np.ndarray) -> np.ndarray:
    """FNV-1a of the eight little-endian bytes of each number."""
    h = np.full(len(x), FNV_OFFSET, np.uint64)
    for shift in range(0, 64, 8):
        h = (h ^ ((x.astype(np.uint64) >> np.uint64(shift)) & np.uint64(255))) * np.uint64(FNV_PRIME)
    return h


def zipf_samples(spark: SparkSession, n: int, items: int, seed: int = 1) -> DataFrame:
    """n draws from a scrambled Zipf distribution: i, item."""
    alpha, zeta2 = 1 / (1 - THETA), 1 + 0.5**THETA
    eta = (1 - (2 / ITEMS) ** (1 - THETA)) / (1 - zeta2 / ZETA)

    @F.pandas_udf("long")
    def draw(u: pd.Series) -> pd.Series:
        x = u.to_numpy()
        rank = np.where(x * ZETA < 1, 0, np.where(x * ZETA < zeta2, 1, (ITEMS * (eta * x - eta + 1) ** alpha))).astype(np.uint64)
        return pd.Series((fnv1a(rank) % np.uint64(items)).astype(np.int64))

    uniform = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return spark.range(n).select(F.col("id").alias("i"), draw(uniform).alias("item"))
