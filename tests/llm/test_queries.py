"""Registered queries on the smallest tables, and those with SQL against DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gleanery.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = entry.queries()[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want.fetchall())


def test_pipeline_stages_keep_their_promises(spark):
    docs = queries.table(spark, SF, "documents").withColumnRenamed("n_chars", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept and kept <= ids, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_pipeline_runs_twice_alike(spark):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert first == again
