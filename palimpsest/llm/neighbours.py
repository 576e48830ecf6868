"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) takes a unit
vector to another; its largest coordinate, with its sign, is the nearest of the 2 d signed
axes.  A table's cell is a pair of such axes, from two rotations; `TABLES` pairs make as many
tables.  A query probes in each table the share of all pairs that lies nearest to it (largest
sum of its two coordinates), and every row of a probed cell is reranked with its original
vector in double precision.

* Largest inner product, not angle, is asked for, so rows are dealt into bands of nearly equal
  length (a factor of sqrt(2)), and each band is probed by angle, to its own depth.
* The depths are fitted on at most `SAMPLE` rows, chosen by hash: for each dimension and band
  the least share on a ladder that finds `RECALL` of the sample's own nearest pairs in the band
  (as many a query as the sample has a share in k of all rows).  All rows are indexed.
* Rows and probes meet by (table, band, first axis), the second axis is compared inside.  Such a
  group is dealt out in blocks of about `BLOCK` rows and `BLOCK` probes, counted beforehand, so one
  that holds a third of all rows is many bounded groups.  A block returns a query's best k, if they
  reach a score that by the sample `AHEAD` times k of all rows reach.
* A query that finds fewer than k rows so goes on to every cell.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, as queries or candidates, and neither do null ids; vectors are compared with
queries of their own length only; rows that share a vec_id are one candidate and one query,
with the best score of any of their vectors; ties go to the smaller vec_id; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise, table

TABLES, NEAREST = 8, 20
BLOCK = 1024
EVERY = 20
SAMPLE, SAMPLE_QUERIES, RECALL, AHEAD = 4096, 256, 0.96, 4
#: Shares of all pairs of axes that a query may probe in a table.
LADDER = [0.5**k for k in range(20, -1, -1)]
LADDER = sorted({*LADDER, *(x * 0.7 for x in LADDER)})
#: Axes of a rotation that a probe's pairs are made of, unless it probes everything.
AXES = 256


def rotated(vectors: np.ndarray, number: int) -> np.ndarray:
    """Three rounds of signs and Hadamard transform, and the negative; rows are padded with zeros to a power of two."""
    d = 1 << max(1, int(np.ceil(np.log2(max(2, vectors.shape[1])))))
    x = np.zeros((len(vectors), d))
    x[:, : vectors.shape[1]] = vectors
    for signs in np.random.default_rng([1515, number]).choice([-1.0, 1.0], (3, d)):
        x = x * signs
        h = 1
        while h < d:
            x = x.reshape(len(x), -1, 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), -1)
            h *= 2
        x /= np.sqrt(d)
    return np.concatenate([x, -x], 1)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # lengths may be beyond a double's range
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def bands(vectors: np.ndarray) -> np.ndarray:
    """Number of the vectors' length band."""
    most = np.abs(vectors).max(1)
    return np.floor(2 * (np.log2(most) + np.log2(np.linalg.norm(vectors / most[:, None], axis=1))) + 0.5).astype(np.int64)


def least_sums(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """For each row of coordinates a and b, the least sum of a pair of axes among the best `share` of pairs."""
    pairs = a.shape[1] * b.shape[1]
    n = int(np.ceil(share * pairs))
    if n >= min(pairs, AXES * AXES):
        return np.full(len(a), -np.inf)
    top = lambda x: -np.partition(-x, AXES - 1, axis=1)[:, :AXES] if x.shape[1] > AXES else x
    a, b, out = top(a), top(b), np.empty(len(a))
    for i in range(len(a)):
        sums = (a[i][:, None] + b[i]).ravel()
        out[i] = sums[np.argpartition(sums, len(sums) - n)[len(sums) - n]]
    return out


class Index:
    """The sample, by dimension, and how deep each of its bands is probed; a band that the sample lacks is probed whole."""

    def __init__(self, sample: list[np.ndarray], n_rows: int, k: int):
        self.rank, self.sample, self.depth = max(AHEAD, -(-AHEAD * k * len(sample) // max(1, n_rows))), {}, {}
        by: dict[int, list[np.ndarray]] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        for d, rows in by.items():
            self.sample[d] = np.stack(rows)
            self._fit(d, self.sample[d], max(1, -(-k * len(sample) // max(1, n_rows))))

    def _fit(self, d: int, x: np.ndarray, k: int) -> None:
        q, band = x[:SAMPLE_QUERIES], bands(x)
        scores = q @ x.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        query = np.repeat(np.arange(len(q)), near.shape[1])
        best, u = near.ravel(), unit(x)
        least = np.ones(len(best))  # the least share with which a table finds the pair
        for t in range(TABLES):
            a, b = rotated(u, 2 * t), rotated(u, 2 * t + 1)
            sums = a[query, a[best].argmax(1)] + b[query, b[best].argmax(1)]
            for share in LADDER[::-1]:
                least = np.where(sums >= least_sums(a[: len(q)], b[: len(q)], share)[query], np.minimum(least, share), least)
        for n in np.unique(band).tolist():
            own = np.sort(least[band[best] == n])
            self.depth[d, n] = float(own[min(len(own) - 1, int(np.ceil(RECALL * len(own))))]) if len(own) else LADDER[0]

    def share(self, d: int, band: int) -> float:
        return self.depth.get((d, band), 1.0)

    def least_score(self, q: np.ndarray) -> np.ndarray:
        """What a score must reach at first: about `AHEAD` times k rows do, by the sample (which may hold the query itself)."""
        x = self.sample.get(q.shape[1])
        if x is None or len(x) <= self.rank:
            return np.full(len(q), -np.inf)
        at = len(x) - self.rank - 1
        return np.partition(q @ x.T, at, axis=1)[:, at]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("embedding")).where(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0)).where(fine)


def _stack(batch: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in batch])


_PLACE = "table_no int, band long, axis int, dimension int, second int, vec_id long, slack double, least double, embedding array<double>"


def indexed(rows: DataFrame) -> DataFrame:
    """Each row's place in each table."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len)
            for n in sizes.unique():
                some = batch[sizes == n]
                vectors = _stack(some["embedding"])
                band, u = bands(vectors), unit(vectors)
                for t in range(TABLES):
                    a, b = rotated(u, 2 * t).argmax(1), rotated(u, 2 * t + 1).argmax(1)
                    yield pd.DataFrame({"table_no": t, "band": band, "axis": a, "dimension": n, "second": b, "vec_id": some["vec_id"].to_numpy(), "slack": np.nan, "least": np.nan, "embedding": some["embedding"].to_numpy()})

    return rows.mapInPandas(place, _PLACE)


def probes(queries: DataFrame, index: Index, known: list[tuple[int, int]], whole: bool) -> DataFrame:
    """Each query's probed first axes in each table and band, and how far the second coordinate may fall (`slack`).

    With `whole`, every axis of the first table, which holds every row.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            sizes = batch["embedding"].map(len)
            for n in sizes.unique():
                some = batch[sizes == n]
                vectors, ids, held = _stack(some["embedding"]), some["vec_id"].to_numpy(), some["embedding"].to_numpy()
                u, least = unit(vectors), np.full(len(some), -np.inf) if whole else index.least_score(vectors)
                for t in range(1 if whole else TABLES):
                    a, b = rotated(u, 2 * t), rotated(u, 2 * t + 1)
                    cut: dict[float, np.ndarray] = {}
                    for band in (z for d, z in known if d == n):
                        share = 1.0 if whole else index.share(n, band)
                        if share not in cut:
                            cut[share] = least_sums(a, b, share)
                        slack = cut[share][:, None] - a
                        i, axis = np.nonzero(slack <= b.max(1)[:, None])
                        yield pd.DataFrame({"table_no": t, "band": band, "axis": axis, "dimension": n, "second": 0, "vec_id": ids[i], "slack": slack[i, axis], "least": least[i], "embedding": held[i]})

    return queries.mapInPandas(place, _PLACE)


def searched(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each probe's best k in each block."""
    key = ["table_no", "band", "axis", "dimension"]
    deal = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = rows.groupBy(*key).agg(deal(F.count("*")).alias("blocks")).join(asked.groupBy(*key).agg(deal(F.count("*")).alias("rounds")), key)
    sizes = materialise(sizes)  # tables x bands x axes rows
    columns = [*key, "block", "round", "query", "second", "vec_id", "slack", "least", "embedding"]
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = rows.join(F.broadcast(sizes), key).withColumn("block", block(F.col("blocks"), 1)).withColumn("round", every(F.col("rounds"))).withColumn("query", F.lit(False))
    probing = asked.join(F.broadcast(sizes), key).withColumn("block", every(F.col("blocks"))).withColumn("round", block(F.col("rounds"), 2)).withColumn("query", F.lit(True))

    def rerank(at: tuple, group: pd.DataFrame) -> pd.DataFrame:
        asked, held = group[group["query"]], group[~group["query"]]
        out: list[tuple] = []
        if len(asked) and len(held):
            q, x, ids, asked_ids = _stack(asked["embedding"]), _stack(held["embedding"]), held["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
            second, slack, least = held["second"].to_numpy(), asked["slack"].to_numpy(), asked["least"].to_numpy()
            coordinates = rotated(unit(q), 2 * int(at[0]) + 1)
            for i in range(len(q)):
                some = np.flatnonzero((coordinates[i, second] >= slack[i]) & (ids != asked_ids[i]))
                exact = (x[some] * q[i]).sum(1)
                some, exact = some[exact >= least[i]], exact[exact >= least[i]]
                order = np.lexsort((ids[some], -exact))
                # rows that share an id are one: only its best score takes a place
                order = order[np.sort(np.unique(ids[some][order], return_index=True)[1])][:k]
                out.append((np.full(len(order), asked_ids[i]), ids[some][order], exact[order]))
        query_id, vec_id, score = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [])
        return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

    found = held.select(columns).unionByName(probing.select(columns)).groupBy(*key, "block", "round").applyInPandas(rerank, "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest candidates found."""
    rows, queries = usable(rows), usable(queries)
    n_rows = rows.count()
    sample = [np.asarray(r.embedding, np.float64) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    index = Index(sample, n_rows, k)
    placed = materialise(indexed(rows))
    known = [(r.dimension, r.band) for r in placed.select("dimension", "band").distinct().collect()]  # at most some thousand bands a dimension
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = materialise(ranked(searched(placed, materialise(probes(queries, index, known, False)), k)))
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialise(queries.join(full, "vec_id", "left_anti"))
    again = ranked(searched(placed.where("table_no = 0"), materialise(probes(short, index, known, True)), k))
    done = first.join(full.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi").unionByName(again)
    return done.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))
