"""The registered queries against their SQL, and the pipeline against its parts and on odd documents."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from knownwhen.llm import quality
from knownwhen.llm.queries import load
from tests.oracle import DATA, compare, database

SF_DIR = str(DATA / "sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_a_row_for_each_input_row(spark, name):
    table = "pages" if name.startswith("op5") else "documents"
    assert QUERIES[name](spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, before = stage(spark, docs, SF_DIR), docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.dtypes == before.dtypes
    model = quality.fit(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    good = quality.score(spark.read.parquet(f"{SF_DIR}/documents.parquet"), model).where("score >= 0.5").select("doc_id")
    assert docs.join(good, "doc_id", "left_anti").count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, docs.collect())) == Counter(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))


def test_rows_not_ids_and_columns_of_any_name(spark):
    text = "One long first line of this text and some further words that make it longer"
    rows = [(1, text), (2, text + " once more today"), (2, "Quite another text that merely shares its id with a copy of the first"), (5, text), (5, text), (None, text)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("copy", "shuffle_key", "n_lines", "n_removed", "component_id", "n_shingles"):
        docs = docs.withColumn(name, F.lit("mine"))
    kept = corpus_pipeline.near_copies(spark, docs, SF_DIR)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[0], rows[2], rows[5]])
    for stage in (corpus_pipeline.near_copies, corpus_pipeline.source_mixture, corpus_pipeline.repeated_lines):
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.where("copy <> 'mine' or shuffle_key <> 'mine' or n_lines <> 'mine' or n_removed <> 'mine'").isEmpty()


def test_stages_on_odd_documents(spark):
    text = "One long first line of this text\nand one more line that is not short"
    rows = [(1, text, "en", "a", 70), (2, text, "en", "a", 70), (3, text.replace("more", "mores"), "en", None, 71), (4, None, None, "a", None), (5, "", "de", "b", 0), (None, "Some other text in a row without id", "en", "b", 5), (1, text, "en", "a", 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("gone", F.lit(1)).withColumn("score", F.lit(2))
    kept = corpus_pipeline.repeated_lines(spark, docs, SF_DIR)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, text), (1, text), (4, ""), (5, ""), (0, rows[5][1])])
    assert corpus_pipeline.near_copies(spark, docs, SF_DIR).where("doc_id in (1, 2)").select("doc_id").distinct().count() == 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() >= 0
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
