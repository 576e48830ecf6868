"""The corpus pipeline: toxicity, line dedup, MinHash dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all
but the last return the columns of `documents`.  Nulls, repeated rows and ties are as the
operators' modules say, empty tables give empty tables, and further columns, whatever their
names, are handed on.

* toxicity drops documents that score at least the operator's threshold; null and empty texts stay.
* line_dedup deletes later copies of line runs of three lines or 25 characters, updates n_chars, and drops documents of which
  nothing is left because every line is a later copy.
* minhash_dedup keeps the document with the smallest doc_id of each group of links from 0.8; rows that share a
  doc_id, and rows without one, stay together.
* decontamination drops documents that hold a benchmark window; null texts stay, and of rows that share a doc_id
  only those whose text holds one go.
* packing returns the pieces of the rest; repeated rows are packed separately, null texts as one end token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, line_dedup, minhash_dedup, packing, toxicity
from palimpsest.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(docs, min_chars=line_dedup.MIN_CHARS)
    left = out.where("n_lines = 0 or n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("row.text")).otherwise(F.col("row.n_chars"))
    return left.select(F.col("row").withField("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = materialise(minhash_dedup.linked(docs, minhash_dedup.STAGE_THRESHOLD).where("not kept").select("doc_id").distinct())
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = materialise(hits.where(F.size("hit") > 0).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_hash"]), "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL: the toxicity model and the tokenizer can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
