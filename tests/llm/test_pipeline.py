"""The pipeline's stages one after the other, and the text queries beside their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_results import connect, differences
from rateline.llm import queries
from rateline.llm.sql import SQL
from rateline.sources.workspace import materialize, scope

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert differences(got, connect(FOLDER).sql(SQL[name]).df()) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, FOLDER))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3]
    often = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert often <= 4, "no few rows are repeated to fill the share of a domain"
    assert docs.filter("n_chars <> length(text)").count() == 0
    assert docs.filter(F.col("text").contains("@mail")).count() == 0


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_take_odd_rows(spark, odd_docs, rows):
    docs = odd_docs if rows == "odd" else odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, FOLDER))
        assert docs.columns == odd_docs.columns
    pieces = corpus_pipeline.pack_windows(spark, docs, FOLDER)
    assert (pieces.count() > 0) == (rows == "odd")


def test_scope_removes_step_folders(spark, tmp_path):
    import os

    folder = spark.conf.get("spark.checkpoint.dir") + "/rateline"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scope(spark):
        kept = materialize(materialize(spark.range(5).toDF("x")), "kept", keep=True)
        assert set(os.listdir(folder)) - before
    left = set(os.listdir(folder)) - before
    assert kept.count() == 5 and len(left) == 1
