"""What one task holds does not grow with the table."""

import pytest
from pyspark.sql import functions as F

from quadrille import session, vocab
from quadrille.operators import audit as A
from quadrille.operators import documents as D
from quadrille.operators import traverse as V
from quadrille.operators import triples as T
from quadrille.plans import load_all
from quadrille.plans.registry import QUERIES
from tests.conftest import rows

DIR = "/root/testdata/sf0.001"


def test_approximate_and_exact_counts_are_made_apart(spark, capsys):
    load_all()
    QUERIES["a4_count_distinct_approximate"](spark, DIR).explain()
    lines = capsys.readouterr().out.splitlines()
    sketches = [line for line in lines if "approx_count_distinct" in line and "keys=" in line]
    # One sketch for each flag and part was made before.
    assert sketches and not any("l_partkey" in line.split("keys=")[1].split("]")[0] for line in sketches)


@pytest.fixture
def few(monkeypatch):
    """Ten rows for a task."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 10, raising=False)


def quads_of(spark, n, predicate="p"):
    made = [F.concat(F.lit("s"), "id"), F.lit(predicate), F.lit("o"), F.lit("iri"), F.lit(None), F.lit(None), F.lit("g")]
    return spark.range(n).select(*[c.cast("string").alias(name) for c, name in zip(made, vocab.QUAD_COLUMNS, strict=True)])


def most_rows(df):
    """Of one task."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_merged_quads_are_dealt_by_their_number(spark, few):
    merged = T.merge_quads(quads_of(spark, 600), quads_of(spark, 1000))
    assert merged.count() == 1000 and merged.rdd.getNumPartitions() >= 160 and most_rows(merged) <= 40


def test_stored_quads_are_written_by_many_tasks(spark, few, tmp_path):
    path = str(tmp_path / "quads")
    T.write_quads(quads_of(spark, 600).union(quads_of(spark, 600, "q").withColumn("graph", F.lit("h"))), path)
    files = len(list((tmp_path / "quads").rglob("*.parquet")))
    assert files >= 100
    T.drop_stored_graph(spark, path, "h")
    assert rows(T.graph_counts(T.read_quads(spark, path))) == [("g", 600)]


def test_wide_rows_of_a_class_are_dealt_by_their_number(spark, few):
    typed = quads_of(spark, 600, vocab.TYPE)
    wide = T.property_table(lambda predicates: typed.unionByName(quads_of(spark, 600)).filter(F.col("predicate").isin(predicates)), "o", {"x": "p"})
    assert wide.filter("x = 'o'").count() == 600 and wide.rdd.getNumPartitions() >= 120


def test_appended_quads_meet_the_stored_ones_in_one_shuffle(spark, few, tmp_path):
    path = str(tmp_path / "quads")
    # Nulls, repeats, quads stored and not, and a predicate of its own.
    first, more = quads_of(spark, 300), quads_of(spark, 500).union(quads_of(spark, 500)).union(quads_of(spark, 5, "q"))
    assert rows(T.append_quads(first, path)) == [("g", 300)]
    assert rows(T.append_quads(more, path)) == [("g", 205)] and T.append_quads(more, path).count() == 0
    assert T.read_quads(spark, path).distinct().count() == T.read_quads(spark, path).count() == 505
    assert len(list((tmp_path / "quads").rglob("*.parquet"))) >= 40


def test_extraction_triples_are_dealt_by_their_number(spark, few):
    found = spark.range(200).select(
        F.concat(F.lit("t"), "id").alias("text_span"), F.lit("kg:Firm").alias("ontology_class"), F.lit(0.5).alias("confidence_score"),
        F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")).alias("char_interval"), F.create_map(F.lit("k"), F.lit("v")).alias("attributes"))
    made = D.extraction_triples(found.union(found), "job", F.lit("file:a"), "g", {})
    assert made.count() == 200 * 9 and made.rdd.getNumPartitions() >= 180 and most_rows(made) <= 40


def test_entailed_quads_are_dealt_by_their_number(spark, few):
    schema = quads_of(spark, 1, vocab.DOMAIN).withColumn("subject", F.lit("p")).withColumn("object", F.lit("C"))
    closed = V.rdfs_closure(quads_of(spark, 600).union(schema))
    assert closed.count() == 1201 and closed.rdd.getNumPartitions() >= 120 and most_rows(closed) <= 40


def test_provenance_makes_all_quads_once(spark):
    rows_of = [("a1", "b/queryHash", "h1", "literal"), ("a2", "b/queryHash", "h2", "literal"), ("e1", vocab.PROV + "wasGeneratedBy", "a1", "iri"),
               ("e2", vocab.PROV + "wasGeneratedBy", "a2", "iri"), ("e1", "b/x", "y", "iri"), ("e1", "b/x", "y", "iri")]
    quads = spark.createDataFrame([(*r, None, None, "g") for r in rows_of], vocab.QUAD_DDL)
    asked = []

    def source(predicates):
        asked.append(predicates)
        return quads if predicates is None else quads.filter(F.col("predicate").isin(predicates))

    got = A.provenance_by_hash(source, spark.createDataFrame([("h1",)], "query_hash string"), "b/")
    assert rows(got, "subject", "object") == [("a1", "h1"), ("e1", "a1"), ("e1", "y")] and asked.count(None) == 1
