"""The numbered queries and the pipeline on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tickerloom.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, name):
    got = llm.queries()[name](spark, SF).toPandas()
    assert len(got) > 0
    if sql := llm.oracle_sql().get(name):
        c = duckdb.connect()
        for t in ("documents", "benchmark", "labels"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = c.sql(sql).df()
        columns = sorted(got.columns)
        tidy = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
        pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in left.select("doc_id").collect()}
    assert 0 < left.count() < docs.count()
