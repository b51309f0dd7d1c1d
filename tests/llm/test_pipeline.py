"""The pipeline's stages, and the queries at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from compare import SMALL, duck_rows, spark_rows

import corpus_pipeline
from tessera.llm import queries


def test_stages_run_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == before
    assert sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_are_the_ones_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SMALL)) == duck_rows(queries.oracle_sql()[name], SMALL)
