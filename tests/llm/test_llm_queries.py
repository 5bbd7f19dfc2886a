"""The registered queries and the pipeline on the supplied tables."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from check_oracle import rows_of
from quadrille.llm import queries
from quadrille.plans.registry import SCHEMAS

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_with_sql(spark, name):
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    result = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql(spark, name):
    documents = spark.read.parquet(f"{DIR}/documents.parquet").count()
    rows = queries.QUERIES[name](spark, DIR).count()
    assert rows == documents or name == "op10_license_scan" and 0 < rows < documents


def test_names():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = stage(spark, docs, DIR)
        if name != "byte_bpe":
            assert out.columns == columns and out.dtypes == docs.dtypes
        docs = corpus_pipeline.materialise(out, name)
        assert 0 < docs.count() <= before
        if name in ("line_dedup", "byte_bpe"):
            assert docs.count() == before
    assert docs.filter("NOT round_trip").count() == 0
    empty = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0
