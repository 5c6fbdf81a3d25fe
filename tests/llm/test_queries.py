import corpus_pipeline
import pytest
from archgraph.llm import queries
from tests.compare import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), small, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op13_phrases"}))
def test_one_row_for_each_document(spark, small, name):
    got = sorted(r["doc_id"] for r in queries.QUERIES[name](spark, small).collect())
    assert got == sorted(r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect())


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        if name != "packing":
            assert docs.columns == columns
        now = docs.count()
        assert 0 < now <= before
        before = now
    assert docs.select("doc_id").distinct().count() == before
