"""Helpers shared by the corpus operators.

Every operator takes a DataFrame and returns a DataFrame.  Intermediate results
that are used more than once are written as Parquet below the cluster's shared
checkpoint folder (`spark.checkpoint.dir`), so a lost executor costs a reread and
never a local file.

Texts reach Python as Arrow batches.  Columns that are only handed on stay Arrow
(`mapped`), so a null beside a large id changes neither.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that a Python worker holds at once, or one text if that is longer.  Its words' arrays then stay in a core's cache.
BATCH_BYTES = 1 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables.  A session that sets no bound on the bytes of an Arrow batch gets BATCH_BYTES."""
    if spark.conf.get(_ARROW_BYTES, None) is None:
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Without one, a temporary folder in local mode and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/palimpsest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _slices(stream: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """Texts as UTF-8 bytes (nulls as empty) and their rows, at most BATCH_BYTES at a time."""
    for batch in stream:
        texts = batch.column(text).cast(pa.binary()).to_pylist()
        size, lo = 0, 0
        for hi, x in enumerate(texts):
            n = len(x) if x else 0
            if hi > lo and size + n > BATCH_BYTES:
                yield [x or b"" for x in texts[lo:hi]], batch.slice(lo, hi - lo)
                size, lo = 0, hi
            size += n
        if len(texts) > lo:
            yield [x or b"" for x in texts[lo:]], batch.slice(lo)


Work = Callable[[Iterator[tuple[list[bytes], pa.RecordBatch]]], Iterator[tuple[pa.RecordBatch | None, Sequence[int] | None, dict]]]


def mapped(df: DataFrame, work: Work, added: str, keep: Sequence[str] = (), text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """The `keep` columns of rows that `work` picks, with the columns it adds (`added`, as DDL).

    `work` takes (texts, rows) slice by slice, and yields (rows, places in them or None for all, new columns).
    `rows` has the columns of `also`, too.
    """
    source = df.select(*dict.fromkeys([*keep, *also, text]))
    schema = StructType([*(source.schema[c] for c in keep), *StructType.fromDDL(added).fields])
    arrow, keep = to_arrow_schema(schema), list(keep)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at, new in work(_slices(stream, text)):
            held = []
            for c in keep:
                column = rows.column(c)
                held.append(column if at is None else column.take(pa.array(at, pa.int64())))
            made = [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(c).type) for c, x in new.items()]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*held, *made], arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def grouped(df: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """`work` on each group of rows with equal keys (integers), as arrays by column; it returns rows of `schema`.

    For many small groups: a batch of rows is split by array operations, and the partitions are not coalesced.
    A group must fit into memory.
    """
    names = StructType.fromDDL(schema).names
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            found = [x for a, b in zip(edges, edges[1:]) for x in work({c: v[a:b] for c, v in columns.items()})]
            return pd.DataFrame(found, columns=names)

        for batch in batches:
            rows = pd.concat([*rest, batch], ignore_index=True) if rest else batch
            of = rows[keys].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1]) if len(rows) else np.zeros(1, np.int64)
            if edges[-1]:
                yield done(rows.iloc[: edges[-1]], edges)
                rest = [rows.iloc[edges[-1] :]]
            else:
                rest.append(batch) if rest else rest.extend([batch])
        if rest and sum(map(len, rest)):
            rows = pd.concat(rest, ignore_index=True)
            yield done(rows, np.array([0, len(rows)]))

    return df.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A list column from all its values and where each list begins (and the last ends)."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd multiplier for each of two hash families.
_BYTE = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a batch of texts, hashed: words are runs without ASCII white space.

    `word` has a 64-bit hash per word; document `i` owns words `first[i]:first[i + 1]`.
    Two families (0 and 1) are independent; used together they give 128 bits.
    """

    def __init__(self, texts: list[bytes], family: int = 0):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        ends = np.cumsum([len(x) + 1 for x in texts]) if texts else np.zeros(0, int)
        self.first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
        self.data, self.start, self.end = data, start, end
        self.word = np.zeros(len(start), np.uint64)
        block = 1 << 22  # bounds the temporary arrays for a batch of very long texts
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + block)))
            a, b = start[lo], end[hi - 1]
            power = _powers(_ODD[family], b - a)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[family][data[a:b]] * power, dtype=np.uint64)])
            inverse = np.uint64(pow(int(_ODD[family]), -1, 2**64))
            h = (total[end[lo:hi] - a] - total[start[lo:hi] - a]) * _powers(inverse, b - a)[start[lo:hi] - a]
            self.word[lo:hi] = mix(h + np.uint64(0x9E3779B97F4A7C15) * (end[lo:hi] - start[lo:hi]).astype(np.uint64))
            lo = hi
        self.document = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def runs(self, n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of `n` consecutive words of one document."""
        w, m = self.word, len(self.word) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = h * _STEP[family] + w[j : j + m]
        at = np.flatnonzero(self.document[:m] == self.document[n - 1 : n - 1 + m])
        return mix(h[at]), at
