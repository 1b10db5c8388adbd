"""Empty tables, clashing columns and odd rows through operators and pipeline stages."""

import random

import pytest
from pyspark.sql import functions as F
from tests.llm.test_llm import SF, empty_documents, odd_documents

from tidemark.llm import decontam, html_paths, pq_neardup, warc


def test_clashing_columns_do_no_harm(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert same(warc.archive_round_trip(pages), warc.archive_round_trip(pages.selectExpr("*", "1 as HTML", "'x' as Page_ID")))
    assert same(html_paths.extract_pages(pages), html_paths.extract_pages(pages.selectExpr("*", "1 as HTML", "'x' as URL")))
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(200)
    assert same(pq_neardup.embedding_links(vectors), pq_neardup.embedding_links(vectors.selectExpr("*", "1 as LABEL", "'x' as Embedding")))
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert same(decontam.decontaminate(docs, items), decontam.decontaminate(docs.selectExpr("*", "1 as TEXT"), items.selectExpr("*", "1 as Text", "2 as ITEM_ID")))


def test_empty_tables(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.decontaminate(empty_documents(spark), items).count() == 0
    assert decontam.decontaminate(odd_documents(spark), items.limit(0)).where("contaminated").count() == 0
    assert pq_neardup.embedding_links(spark.read.parquet(f"{SF}/embeddings.parquet").limit(0)).count() == 0


def test_queries_of_a_list_are_split(spark):
    """One label, one hot list of near vectors: blocks of members by parts of queries give each pair once."""
    rng = random.Random(3)
    rows = [(i, "a", [1.0 + rng.gauss(0, 0.02), rng.gauss(0, 0.02)]) for i in range(260)]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq_neardup.embedding_links(frame, block=5).collect()}
    assert got == {i: (259, 0) for i in range(260)}


@pytest.mark.parametrize("rows", ["empty", "odd"])
def test_pipeline_stages_on_odd_tables(spark, rows):
    import corpus_pipeline

    docs = empty_documents(spark) if rows == "empty" else odd_documents(spark)
    kinds = spark.read.parquet(f"{SF}/documents.parquet").schema
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and (rows == "odd" or not ids)
        if k < 4:
            assert docs.columns == kinds.names
    if rows == "odd":
        assert set(ids) <= {4, 5, 6, 7, 8, 9} and docs.where(F.col("n_tokens") < 2).count() == 0
