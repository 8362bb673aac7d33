"""The pipeline's stages on the smoke tables and on a table with awkward rows."""

import corpus_pipeline
import duckdb
import pytest

from fieldtrust.llm import queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == names, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= before
        before = docs.count()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert ids.count() == before and ids.where("not parity or not round_trip").count() == 0


def test_awkward_rows(spark, sf_dir):
    rows = [(1, None, 0.5, "k", 3), (2, "", None, None, 0), (None, "a text", 1.0, "k", 6), (3, "same same", 1.0, "k", 9), (3, "same same", 1.0, "k", 9), (4, "w " * 30000, 1.0, "k", 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, k1 string, n_replaced int")
    for table in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert out.count() <= table.count(), name
            if name != "encoding":
                assert out.columns == docs.columns, name
    one = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert one.where("doc_id = 3").count() == 1


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    rows = got.toPandas()
    assert len(rows)
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.sql(queries.ORACLE[name]).df()
        key = list(rows.columns)
        assert sorted(map(str, rows[key].values.tolist())) == sorted(map(str, want[key].values.tolist()))
