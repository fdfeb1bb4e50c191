"""Registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

import pytest

import corpus_pipeline
from actlens.llm import queries as Q
from tests.llm.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    got, want = compare(spark, name, SMALL)
    assert got == want and got


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
    assert 0 < docs.count() < rows
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_pieces", "pieces", "lossless"]
    assert out.filter("not lossless").count() == 0 and out.count() > 0
