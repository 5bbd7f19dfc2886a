from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quadrille.functions import columns as C
from quadrille.operators import audit as A
from quadrille.operators import governance as G
from tests.conftest import rows


RULES = [("owner", None, None), ("reviewer", "read", None), ("buyer", "read", "orders")]


def test_access_cases(spark):
    requests = spark.createDataFrame(
        [(1, "buyer", "read", "orders"), (2, "buyer", "read", "stock"), (3, "reviewer", "read", "anywhere"),
         (4, "reviewer", "write", "orders"), (5, "owner", "write", None), (6, None, "read", "orders"), (7, "stranger", "read", "x")],
        "id int, role string, action string, context string")
    assert {r["id"]: r["allow"] for r in G.decide(requests, RULES).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False}


def test_unknown_levels_deny(spark):
    policies = spark.createDataFrame([("a", ["buyer"], [], "internal"), ("b", ["buyer"], [], "lowest"), ("c", ["buyer"], [], None)],
                                     "policy string, read array<string>, write array<string>, required string")
    requests = spark.createDataFrame([(i, p, "buyer", "read", c) for i, (p, c) in enumerate(
        [("a", "internal"), ("a", "odd"), ("a", None), ("b", "top_secret"), ("c", "top_secret"), ("b", "odd"), ("d", "top_secret")])],
        "id int, policy string, role string, action string, clearance string")
    assert [r["id"] for r in G.decide_by_policy(requests, policies).filter("allow").collect()] == [0]


def test_row_filter_binds_the_tenant_as_a_literal(spark):
    df = spark.createDataFrame([("a'b", 1), ("x", 2)], "tenant string, n int")
    assert rows(G.row_filter(df, "r", "a'b", {"tenant": "{{tenant}}"})) == [("a'b", 1)]
    assert rows(G.row_filter(df, "r", "x' OR '1'='1", predicates={"r": "tenant = '{{tenant}}'"})) == []
    assert G.row_filter(df, "r", "x", predicates={"other": "1 = 0"}).count() == 2
    with pytest.raises(ValueError, match="tenant_id"):
        G.row_filter(df, "r", "x", {"tenant_id": "x"})


def test_mask(spark):
    df = spark.createDataFrame([("Ann", "1")], "customer_name string, n string")
    assert rows(G.mask(df, "buyer", "confidential", ["customer_name", "none"])) == [("***", "1")]
    assert rows(G.mask(df, "reviewer", "public", ["customer_name"], ["reviewer"])) == rows(G.mask(df, "buyer", "restricted", ["n"])) == [("Ann", "1")]


def test_tenancy(spark):
    df = spark.createDataFrame([("kg://acme/x",), ("kg://acme-two/x",), ("kg://global/x",), (None,)], "graph string")
    assert rows(G.own_graphs(df, "acme")) == [("kg://acme/x",), ("kg://global/x",)]


def test_retention(spark):
    df = spark.createDataFrame([("long", datetime(2017, 6, 1)), ("short", datetime(2021, 6, 1)), ("short", datetime(2023, 6, 1)),
                                ("other", datetime(1999, 1, 1)), ("short", None)], "kind string, at timestamp_ntz")
    got = G.retain(df, "kind", "at", F.lit("2024-01-01").cast("date"), {"long": 7, "short": 2})
    assert got.count() == 4


def test_lineage_events(spark):
    df = spark.createDataFrame([
        ('{"eventType":"complete","job":{"name":"j"},"run":{"runId":"r","facets":{"ingestion":{"tenant_id":"t"}}}}',),
        ('{"eventType":"FAIL","job":{"name":"j"},"run":{"runId":"r2"}}',), ('{"eventType":"START","run":{}}',),
        ('{"eventType":"OTHER"}',), ("not json",), (None,)], "value string")
    assert rows(A.lineage_to_audit(df), "tenant_id", "status", "query_hash") == [
        ("t", "success", "r"), ("unknown", "error", "r2"), ("unknown", "started", None)]


def test_version_diff_and_drift(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "")], "id int, v string, w string")
    new = spark.createDataFrame([(1, "a", ""), (2, "b", "x"), (4, "d", "y")], "id int, v string, w string")
    assert rows(A.version_diff(old, new, ["id"])) == [(1, "modified"), (3, "removed"), (4, "added")]
    changed = new.drop("v").withColumn("id", F.col("id").cast("string")).withColumn("z", F.lit(1))
    assert rows(A.drift(old, changed, exact=True), "column", "change") == [("id", "retyped"), ("v", "removed"), ("w", "same"), ("z", "added")]


def test_audit_listing_and_statistics(spark):
    log = spark.createDataFrame([(i, "t1" if i % 2 else "t2", f"u{i % 3}", None if i == 1 else "c", "query", "success", datetime(2024, 1, 1 + i))
                                 for i in range(1, 9)], "id int, tenant_id string, user_id string, context string, action string, status string, created_at timestamp_ntz")
    got = A.list_audit(log, tenant_id="t1", date_from="2024-01-04", limit=2)
    assert [r["id"] for r in got.collect()] == [7, 5]
    stats = {(r["measure"], r["name"]): r["count"] for r in A.audit_statistics(log, "t1").collect()}
    assert stats[("total", None)] == 4 and stats[("context", "c")] == 3 and ("context", None) not in stats


def test_column_functions(spark):
    import uuid

    df = spark.createDataFrame([("aml-0-x",), ("ü",)], "n string")
    for r in df.select("n", C.uuid5(F.col("n")).alias("u")).collect():
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"]))
    d = spark.createDataFrame([("http://a/b#c", "rdf:type", "x:y", "True", "abc")], "iri string, c string, u string, f string, n string")
    r = d.select(C.local_name(F.col("iri")), C.expand_curie(F.col("c")), C.expand_curie(F.col("u")), C.flag(F.col("f")), C.lenient(F.col("n"))).first()
    assert tuple(r) == ("c", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "x:y", True, None)
    with pytest.raises(ValueError):
        C.operator_condition({"field": "n", "operator": "~", "value": 1})
    keyless = spark.range(4).select(C.subject_template("b/", "t", []).alias("s"))
    assert keyless.distinct().count() == 4


def test_row_ids_follow_the_order(spark):
    import uuid

    df = spark.range(50).selectExpr("id", "concat('t', id) AS at").repartition(7)
    got = {r["id"]: r["transaction_id"] for r in C.row_ids(df, ["id"], "at").collect()}
    assert got == {i: str(uuid.uuid5(uuid.NAMESPACE_URL, f"aml-{i}-t{i}")) for i in range(50)}


def test_null_keys_meet_in_version_diff(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "id int, v string")
    new = spark.createDataFrame([(None, "c"), (1, "b"), (2, "d")], "id int, v string")
    assert sorted(rows(A.version_diff(old, new, ["id"])), key=repr) == sorted([(None, "modified"), (2, "added")], key=repr)


def test_facet_name_and_unreadable_events(spark):
    df = spark.createDataFrame([('{"eventType":"START","run":{"facets":{"myFacet":{"tenant_id":"t"}}}}',), ("{no",), (None,)], "value string")
    assert rows(A.lineage_to_audit(df, facet="myFacet"), "tenant_id") == [("t",)]
    assert A.unreadable_events(df).count() == 2
