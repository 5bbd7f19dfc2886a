"""Stored sketches, page indexes, bucketed tables, reference discovery, late rows and unreadable bodies."""

import datetime as dt
import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quadrille.operators import audit as A
from quadrille.operators import documents as D
from quadrille.operators import quality as K
from quadrille.operators import sketches as H
from quadrille.sources import rdf, tables
from quadrille.streaming import lineage as L
from tests.conftest import rows


def test_sketches_of_several_loads_add_up(spark, tmp_path):
    rng = random.Random(1)
    # A third of all rows on one day and in one group.
    data = [(dt.date(2024, 1, 5) if i % 3 == 0 else dt.date(2024, rng.randrange(1, 5), rng.randrange(1, 28)), "a" if i % 3 == 0 else rng.choice("bc"),
             rng.randrange(2000), rng.random() * 100) for i in range(9000)] + [(None, "b", 1, None)]
    df = spark.createDataFrame(data, "at date, g string, item int, x double")
    path = str(tmp_path / "state")
    for load, part in (("one", df.filter("item % 2 = 0")), ("two", df.filter("item % 2 = 1")), ("two", df.filter("item % 2 = 1"))):
        H.add_load(H.daily_state(part, "at", ["g"], ["item"], ["item"], ["x"]), path, load)
    state = H.read_state(spark, path)
    got = {(r["period"], r["g"]): r for r in H.roll_up(state, "month", ["g"]).collect()}
    groups = {}
    for at, g, item, x in data:
        groups.setdefault((at and at.replace(day=1), g), []).append((item, x))
    assert got.keys() == groups.keys()
    for key, members in groups.items():
        r, items = got[key], {i for i, _ in members}
        assert (r["rows"], int(r["sum_item"]), r["low_item"], r["high_item"]) == (len(members), sum(i for i, _ in members), min(items), max(items))
        assert abs(r["distinct_item"] - len(items)) <= 0.06 * len(items) + 1
        values = sorted(x for _, x in members if x is not None)
        if not values:
            assert r["percentiles_x"] is None
            continue
        for p, v in zip((0.5, 0.95, 0.99), r["percentiles_x"]):
            assert abs(sum(x <= v for x in values) / len(values) - p) < 0.04 + 1 / len(values)
    whole = H.roll_up(state).collect()
    assert len(whole) == 1 and whole[0]["rows"] == 9001
    with pytest.raises(ValueError):
        H.roll_up(state, "fortnight")


def test_pages_by_their_ranges(spark):
    rng = random.Random(2)
    data = [(i, None if i % 11 == 0 else dt.datetime(2024, 1, rng.choice([1, 2, 2, 2, 9]), rng.randrange(24))) for i in range(300)]
    df = spark.createDataFrame(data, "id int, at timestamp_ntz").repartition(4)
    index = K.page_index(df, "at")
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0]), reverse=True)
    for offset in (0, 1, 99, 250, 271, 290, 299, 300, 900):
        assert [tuple(r) for r in K.seek_page(df, index, "at", "id", 40, offset).collect()] == order[offset:offset + 40]
    plan = K.seek_page(df, index, "at", "id", 5, 200)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    with pytest.raises(ValueError):
        K.seek_page(df, index, "at", "id", 501)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(list(r), "k int, v string, at int")
    tables.merge_buckets(df(*[(i, "a", 1) for i in range(200)]), path, ["k"], "at", 8)
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    time.sleep(0.05)
    touched = tables.merge_buckets(df((3, "b", 2), (3, "old", 0), (500, "n", 1)), path, ["k"], "at")
    after = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert 0 < len(touched) <= 2
    for p, t in before.items():
        bucket = int(p.parent.name.split("=")[1]) if "=" in p.parent.name else -1
        assert (p not in after) if bucket in touched else after[p] == t
    now = tables.read_buckets(spark, path, df((0, "", 0)).schema)
    assert rows(now.filter("k IN (3, 4, 500)"), "k", "v") == [(3, "b"), (4, "a"), (500, "n")] and now.count() == 201
    with pytest.raises(ValueError):
        tables.merge_buckets(df((1, "", 0)), path, [])


def test_references_of_all_columns(spark):
    parent = spark.createDataFrame([(i, f"n{i}", i % 2) for i in range(20)], "id int, name string, flag int")
    child = spark.createDataFrame([(i % 7, "n3" if i % 2 else None, 5 if i else 99) for i in range(50)], "ref long, label string, other int")
    got = rows(A.discovered_references({"p": parent, "c": child}), "dependent", "referenced", "values")
    assert got == [("c.label", "p.name", 1), ("c.ref", "p.id", 7), ("p.flag", "p.id", 2)]
    every = {r[:2] for r in rows(A.discovered_references({"p": parent, "c": child}, keys_only=False), "dependent", "referenced")}
    assert ("p.flag", "c.ref") in every and ("c.other", "p.id") not in every
    long = "x" * 500
    texts = {n: spark.createDataFrame([(v,) for v in vs], "t string") for n, vs in (("a", [long, "b"]), ("b", [long, "b", "c", None]))}
    assert rows(A.discovered_references(texts), "dependent", "referenced") == [("a.t", "b.t")]


def test_no_row_of_a_stream_vanishes(spark, tmp_path):
    minute = lambda m, s=0: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m, seconds=s)
    batches = [[("a", minute(0)), ("a", minute(1)), ("b", minute(0)), ("a", minute(40))],
               [("a", minute(1, 5)), ("a", minute(1, 6)), ("a", minute(35)), ("b", minute(2)), ("c", None)],
               [("a", minute(40, 9)), ("b", minute(1)), ("b", minute(60)), ("a", minute(1))], [("b", minute(3)), ("a", minute(41))]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "tenant_id string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    stream = spark.readStream.schema("tenant_id string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    L.start_updates(L.request_counts_with_late(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["kind"], r["tenant_id"], r["minute"].minute + 60 * r["minute"].hour): r["requests"] for r in L.late_report(spark, str(tmp_path / "out")).collect()}
    assert got == {("count", "a", 0): 1, ("count", "a", 1): 1, ("count", "a", 40): 2, ("count", "a", 41): 1, ("count", "a", 35): 1, ("late", "a", 1): 3,
                   ("count", "b", 0): 1, ("count", "b", 1): 1, ("count", "b", 2): 1, ("count", "b", 60): 1, ("late", "b", 3): 1}
    assert sum(got.values()) == sum(len(b) for b in batches) - 1  # one has no time


def test_bodies_that_cannot_be_read(spark):
    bodies = ['[{"id": 1}]', '{"data": [{"id": 2}]}', '{"data": []}', '{"error": "none"}', '{"data": [{"id": 3}', "", '{"data": 7}', '"text"', "12", None]
    faults = tables.page_faults(spark.createDataFrame([(b,) for b in bodies], "value string"), "id: int")
    assert rows(faults) == sorted([("", "no json"), ('"text"', "no list"), ("12", "no list"), ('{"data": 7}', "no list"), ('{"data": [{"id": 3}', "no json"),
                                   (None, "no json")], key=repr)
    bundles = ['{"entry": []}', '{"entry": [{"resource": {}}]}', "{}", '{"entry": 1}', "{not json", json.dumps({"resourceType": "Bundle"})]
    lost = rdf.unreadable_bundles(spark.createDataFrame([(b,) for b in bundles], "value string"))
    assert rows(lost, "fault") == [("no bundle",), ("no bundle",), ("no bundle",), ("no json",)]


def test_mentions_take_one_pass(spark):
    text = spark.createDataFrame([(1, "LEI 5493001KJTIIGC8Y1R12 of 2024-01-02. " * 3)], "id int, text string")
    found = D.distinct_mentions(D.rebase(D.extract(D.chunk(text, "id"), "id")), "id")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 2
    nothing = D.extract(D.chunk(text, "id"), "id", extractor=lambda t: [{"extraction_type": "X", "text_span": "x"}, {"extraction_type": "X", "text_span": "x"}])
    assert D.distinct_mentions(D.rebase(nothing), "id").count() == 2


def test_means_that_lie_on_a_tie_are_settled(spark):
    df = spark.createDataFrame([(0.30625,), (0.30624999999999997,), (0.30625000000000002,)], "x double")
    assert {r[0] for r in df.select(K.settled(F.col("x"), 4)).collect()} == {0.3063}
