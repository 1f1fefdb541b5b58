"""The registered queries against their SQL, and the pipeline from end to end."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(str(tuple(r[i] for i in at)) for r in result.fetchall())
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == want


def test_pipeline_packs_what_the_stages_leave(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
    packed = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in packed.where("piece = 0").collect()) == sorted(r.doc_id for r in docs.collect())
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
