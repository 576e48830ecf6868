"""Every operator and every pipeline stage on nulls beside large ids, repeated rows, clashing names, a very long text, and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import class_lm, decontamination, line_dedup, minhash_dedup, neighbours, packing, quality, substring_dedup, toxicity, url_filter

BIG = 2**60 + 1
TEXT = "some words that are long enough to be a shingle and a line of their own"
LONG = "\n".join(" ".join(f"w{(17 * i + j) % 5000}" for j in range(200)) for i in range(18_000))
ROWS = [(None, TEXT), (BIG, TEXT), (BIG + 2, None), (BIG + 4, TEXT + " more"), (BIG + 4, TEXT + " more"), (BIG + 6, ""), (None, None), (BIG + 8, LONG)]
#: Names that the operators use themselves, or have used.
CLASHING = ["lang", "source", "n_lines", "n_removed", "nc_score", "score", "row", "dd", "text_hash", "class", "key", "pos", "rank", "reference", "n", "word"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING), F.char_length("text").cast("long").alias("n_chars"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(BIG, 1, 0), (BIG + 4, 0, 1), (None, 1, 1), (BIG + 2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, TEXT), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def _read(spark, tables, name, empty=False):
    df = spark.read.parquet(f"{tables}/{name}.parquet")
    return df.limit(0) if empty else df


BY_DOCUMENT = {
    "op2": lambda docs, labels, items: line_dedup.deduplicated(docs, min_chars=line_dedup.MIN_CHARS).select("row.doc_id", "n_lines", F.col("row.n_lines").alias("own"), F.xxhash64("row.text").alias("kept")),
    "op3": lambda docs, labels, items: substring_dedup.factored(docs),
    "op4": lambda docs, labels, items: decontamination.contamination(docs, items, slop=1),
    "op7": lambda docs, labels, items: minhash_dedup.linked(docs),
    "op8": lambda docs, labels, items: class_lm.scored(docs),
    "op9": lambda docs, labels, items: toxicity.toxicity(docs, labels).select("row.doc_id", "score", "row.nc_score"),
    "op10": lambda docs, labels, items: packing.pack(docs, packing.tokenizer_file()).where("piece = 0"),
}


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_result_a_row(spark, tables, name):
    """Nulls and ids above 2^53 come back as they are, repeated rows alike, and the long text whole."""
    inputs = [_read(spark, tables, x) for x in ("documents", "labels", "benchmark")]
    rows = BY_DOCUMENT[name](*inputs).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in ROWS), key=str)
    twice = [r.asDict() for r in rows if r.doc_id == BIG + 4]
    if name == "op10":
        twice = [{k: v for k, v in r.items() if k not in ("sequence_id", "offset")} for r in twice]
    assert twice[0] == twice[1]
    long = next(r for r in rows if r.doc_id == BIG + 8)
    if name == "op2":
        assert long.n_lines == 18_000 and long.own == "own n_lines"
    if name in ("op3", "op4"):
        assert long.n_words == 3_600_000
    if name == "op4":
        assert len(long.hit) and long["items"] == ["1"]
    if name == "op7":
        assert {r.component_id for r in rows if r.doc_id is not None} <= {r.doc_id for r in rows}
    if name == "op8":
        assert long.n_tokens == 3_600_001 and all(r.held_out is not None for r in rows)
    if name == "op9":
        assert {r.nc_score for r in rows} == {"own nc_score"}


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_empty_tables(spark, tables, name):
    assert BY_DOCUMENT[name](*(_read(spark, tables, x, True) for x in ("documents", "labels", "benchmark"))).count() == 0


def test_quality(spark, tables):
    docs, labels = _read(spark, tables, "documents"), _read(spark, tables, "labels")
    rows = quality.resampled(docs, labels.limit(0)).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in ROWS), key=str)
    assert {r.doc_id for r in quality.resampled(docs, labels).collect()} <= {i for i, _ in ROWS}
    assert quality.resampled(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", [x for x in STAGES if x != "packing"])
def test_stages_hand_rows_on(spark, tables, name):
    docs = _read(spark, tables, "documents")
    out = STAGES[name](spark, docs, tables)
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {i for i, _ in ROWS} and {tuple(r[c] for c in CLASHING) for r in rows} == {tuple(f"own {c}" for c in CLASHING)}
    if name == "toxicity":
        assert sum(r.text is None for r in rows) == 2
    if name == "minhash_dedup":
        assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == BIG + 4 for r in rows) in (0, 2)
    if name == "decontamination":
        assert len(rows) == len(ROWS) - 1 and not any(r.doc_id == BIG + 8 for r in rows)
    empty = STAGES[name](spark, docs.limit(0), tables)
    assert empty.columns == docs.columns and empty.count() == 0


def test_neighbours_and_urls(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (BIG, [1.0, 0.1]), (BIG + 2, [0.0, 1.0]), (BIG + 2, [0.0, 1.0]), (BIG + 4, None)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(rows.withColumn("slack", F.lit("own")), rows.where(F.col("vec_id") == BIG)).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(BIG, BIG + 2)]
    pages = spark.createDataFrame([(None, "https://example.com/en/1", LONG, "own"), (BIG, None, None, "own"), (BIG, None, None, "own"), (BIG + 2, "https://" + "a" * 200_000 + ".org/x", "", "own")], "page_id long, url string, html string, words string")
    found = url_filter.judged(pages).collect()
    assert sorted((r.page_id for r in found), key=str) == sorted((None, BIG, BIG, BIG + 2), key=str)
    assert url_filter.judged(pages.limit(0)).count() == 0
