import json

import pytest
from quadrille import session
from quadrille.sources import rdf, tables
from quadrille.streaming import lineage as L
from quadrille.vocab import FHIR, ONTOLOGY, QUAD_DDL, RDF, TYPE, XSD
from tests.conftest import rows

R = RDF


def test_csv_keeps_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Timestamp,From Bank,Amount Paid\n2024-01-15T10:00:00,"Bank ""A"", Inc",007\n')
    df = tables.read_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"Timestamp": "string", "From Bank": "string", "Amount Paid": "string"}
    assert tuple(df.first()) == ("2024-01-15T10:00:00", 'Bank "A", Inc', "007")


def test_jdbc_with_cursor(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("cast(id AS int) AS ID", "concat('n', id) AS NAME").write.jdbc(url, "ITEMS")
    got = tables.read_jdbc(spark, url, ["ITEMS"], cursor="ID", since=89, partition_column="ID", partitions=4, bounds=(0, 100))["ITEMS"]
    assert got.count() == 10 and got.rdd.getNumPartitions() == 4
    assert "GreaterThan(ID,89)" in got._jdf.queryExecution().executedPlan().toString()


def test_json_pages(spark, tmp_path):
    for i, body in enumerate([{"data": [{"id": 1}, {"id": 2}], "next": "x"}, [{"id": 3}], {"error": "none"}, {"data": {"id": 9}}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(body, indent=1))
    assert rows(tables.read_json_pages(spark, str(tmp_path), "id: int")) == [(1,), (2,), (3,)]


def test_merge_keeps_the_latest(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(list(r), "k int, v string, at int")
    tables.write_table(df((1, "a", 1), (2, "b", 5)), path, "merge", ["k"], "at")
    tables.write_table(df((1, "c", 1), (2, "old", 4), (3, "n", 1)), path, "merge", ["k"], "at")
    assert rows(spark.read.parquet(path), "k", "v") == [(1, "c"), (2, "b"), (3, "n")]
    tables.write_table(df((9, "z", 0)), path)
    assert rows(spark.read.parquet(path), "k") == [(9,)]
    with pytest.raises(ValueError):
        tables.write_table(df((9, "z", 0)), path, "merge")


def test_fhir_bundle(spark):
    bundle = {"resourceType": "Bundle", "entry": [
        {"resource": {"resourceType": "Patient", "id": "p1", "birthDate": "1980-01-01", "name": [{"given": ["Ann", "B"], "family": "Co"}, {"family": "Solo"}]}},
        {"resource": {"resourceType": "Observation", "id": "o1", "status": "final", "subject": {"reference": "#Patient/p1"}, "valueQuantity": {"value": 7.20}}},
        {"resource": {"resourceType": "Device", "id": "d1"}}, {"resource": {"resourceType": "Device"}}, {}]}
    df = spark.createDataFrame([(json.dumps(bundle),), ("{}",)], "value string")
    assert set(rows(rdf.fhir_to_triples(df), "subject", "predicate", "object", "datatype")) == {
        (ONTOLOGY + "Patient/p1", TYPE, FHIR + "Patient", None), (ONTOLOGY + "Patient/p1", FHIR + "birthDate", "1980-01-01", XSD + "date"),
        (ONTOLOGY + "Patient/p1", FHIR + "name", "Ann B Co", None), (ONTOLOGY + "Patient/p1", FHIR + "name", "Solo", None),
        (ONTOLOGY + "Observation/o1", TYPE, FHIR + "Observation", None), (ONTOLOGY + "Observation/o1", FHIR + "status", "final", None),
        (ONTOLOGY + "Observation/o1", FHIR + "subject", ONTOLOGY + "Patient/p1", None),
        (ONTOLOGY + "Observation/o1", FHIR + "valueQuantity", "7.2", XSD + "decimal"), (ONTOLOGY + "Device/d1", TYPE, FHIR + "Device", None)}


def test_cim_files(spark, tmp_path):
    (tmp_path / "m.xml").write_text(f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="{R}" xmlns:cim="http://iec.ch/TC57/CIM100#" xml:base="urn:m">
      <cim:Substation rdf:ID="_s1"><cim:IdentifiedObject.name>North &amp; South</cim:IdentifiedObject.name>
        <cim:Substation.Region rdf:resource="#_r1"/></cim:Substation>
      <rdf:Description rdf:about="http://x/y"><cim:note xml:lang="en">hi</cim:note><cim:size rdf:datatype="{XSD}integer">3</cim:size></rdf:Description>
      <cim:Line rdf:about="#_l1"><cim:Line.end><cim:Terminal><cim:n>1</cim:n></cim:Terminal></cim:Line.end></cim:Line></rdf:RDF>""")
    got = rdf.cim_xml_to_triples(spark, str(tmp_path))
    flat = {(r["subject"] if not r["subject"].startswith("_:") else "_", r["predicate"].split("#")[-1], r["object"] if r["object_kind"] != "bnode" else "_",
             r["object_kind"], (r["datatype"] or "").split("#")[-1], r["lang"]) for r in got.collect()}
    assert flat == {("urn:m#_s1", "type", "http://iec.ch/TC57/CIM100#Substation", "iri", "", None),
                    ("urn:m#_s1", "IdentifiedObject.name", "North & South", "literal", "", None),
                    ("urn:m#_s1", "Substation.Region", "urn:m#_r1", "iri", "", None), ("http://x/y", "note", "hi", "literal", "", "en"),
                    ("http://x/y", "size", "3", "literal", "integer", None), ("urn:m#_l1", "type", "http://iec.ch/TC57/CIM100#Line", "iri", "", None),
                    ("urn:m#_l1", "Line.end", "_", "bnode", "", None), ("_", "type", "http://iec.ch/TC57/CIM100#Terminal", "iri", "", None),
                    ("_", "n", "1", "literal", "", None)}


def test_jsonld(spark):
    doc = {"@context": {"ex": "http://ex/", "name": "ex:name", "knows": {"@id": "ex:knows", "@type": "@id"}, "@language": "en",
                        "when": {"@id": "ex:when", "@type": "ex:date"}},
           "@graph": [{"@id": "ex:a", "@type": ["ex:T"], "name": ["A", {"@value": "B", "@language": "de"}], "knows": "ex:b", "when": "2024",
                       "ex:n": 3, "ex:f": 1.5, "ex:t": True, "unmapped": "dropped", "ex:in": {"ex:x": "y"}, "ex:l": {"@list": ["p"]}}]}
    df = spark.createDataFrame([(json.dumps(doc),)], "value string")
    got = {(r["subject"] if not r["subject"].startswith("_:") else "_", r["predicate"], r["object"] if r["object_kind"] != "bnode" else "_", r["datatype"], r["lang"])
           for r in rdf.jsonld_to_triples(df).collect()}
    a = "http://ex/a"
    assert got == {(a, TYPE, "http://ex/T", None, None), (a, "http://ex/name", "A", None, "en"), (a, "http://ex/name", "B", None, "de"),
                   (a, "http://ex/knows", "http://ex/b", None, None), (a, "http://ex/when", "2024", "http://ex/date", None),
                   (a, "http://ex/n", "3", XSD + "integer", None), (a, "http://ex/f", "1.5", XSD + "double", None),
                   (a, "http://ex/t", "true", XSD + "boolean", None), (a, "http://ex/in", "_", None, None), ("_", "http://ex/x", "y", None, "en"),
                   (a, "http://ex/l", "_", None, None), ("_", R + "first", "p", None, "en"), ("_", R + "rest", R + "nil", None, None)}


def test_lines_round_trip(spark, tmp_path):
    quads = [("http://s", "http://p", 'a "quoted" \\ back\nline\ttab \\n ü . <x> # no', "literal", None, None, None),
             ("_:b1", "http://p", "_:b2", "bnode", None, None, "http://g"), ("http://s", "http://p", "v", "literal", XSD + "string", None, "http://g"),
             ("http://s", "http://p", "v", "literal", None, "en-GB", None), ("http://s", "http://p", "http://o", "iri", None, None, None),
             ("http://s", "http://p", "", "literal", None, None, None), ("http://s", "http://p", "long \\ \" " * 20000, "literal", None, None, None)]
    df = spark.createDataFrame(quads, QUAD_DDL)
    rdf.write_ntriples(df, str(tmp_path / "nt"))
    assert rows(rdf.read_ntriples(spark, str(tmp_path / "nt"))) == sorted(quads, key=repr)


def test_jsonld_lines_read_back(spark):
    quads = [("http://s", "http://p", 'a "q" \\ \n ü', "literal", None, None, "http://g"), ("http://s", "http://p", "5", "literal", XSD + "integer", None, None),
             ("http://s", "http://p", "v", "literal", None, "en", None), ("http://s", "http://p", "http://o", "iri", None, None, None)]
    lines = rdf.render_jsonld(spark.createDataFrame(quads, QUAD_DDL)).withColumnRenamed("line", "value")
    assert rows(rdf.jsonld_to_triples(lines).drop("graph")) == sorted([q[:6] for q in quads], key=repr)


def test_lines_of_others(spark):
    lines = ["# comment", "", "<s> <p> <o> . # tail", "<s> <p> \"\\u00e9\\'x\"@fr .", "broken <p> <o> .", "<s> <p> \"x\"^^<t> <g> ."]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(rdf.parse_lines(df), "object", "datatype", "lang", "graph") == sorted(
        [("o", None, None, None), ("é'x", None, "fr", None), ("x", "t", None, "g")], key=repr)


def test_append_only_and_load_statistics(spark, tmp_path):
    log = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, id int")
    tables.append_audit(log, str(tmp_path / "a"))
    tables.append_audit(log, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    assert rows(tables.load_stats({"log": log})) == [("*", 2), ("log", 2)]


def test_incremental(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "c int")
    assert rows(tables.incremental(df, "c", 5)) == [(9,)] and tables.incremental(df, "c", None).count() == 3
    assert tables.cursor_state(df, "c").first()["last_value"] == 9


def test_materialise_lives_in_the_shared_folder(spark):
    df = session.materialise(spark.range(5), "t")
    assert session.scratch_root(spark).removeprefix("file://") in df.inputFiles()[0]
    assert df.count() == 5


def test_stream_restart_takes_only_new_files(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(2):
        spark.createDataFrame([(i,)], "id int").write.mode("append").parquet(landing)
        L.start_file_load(spark, landing, spark.createDataFrame([], "id int").schema, out, state).awaitTermination()
        assert spark.read.parquet(out).count() == i + 1


def test_audit_stream_skips_bad_records_and_resumes(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    good = '{"eventType":"COMPLETE","job":{"name":"j"},"run":{"runId":"%s"}}'
    for i in range(2):
        spark.createDataFrame([(good % f"r{i}",), ("garbage",)], "value string").coalesce(1).write.mode("append").text(landing)
        L.start_audit_sink(L.lineage_stream(spark, "text", path=landing), out, state).awaitTermination()
    assert rows(spark.read.parquet(out), "query_hash") == [("r0",), ("r1",)]


def test_updates_are_exact_over_batches(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, tenant_id string"
    for _ in range(2):
        spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 'a' AS tenant_id FROM range(40)").write.mode("append").parquet(landing)
        counts = L.request_counts(spark.readStream.schema(schema).parquet(landing))
        L.start_updates(counts, out, state).awaitTermination()
    got = L.latest_updates(spark, out, counts.schema, ["minute", "tenant_id"]).first()
    assert (got["requests"], got["over_limit"], got["remaining"]) == (80, True, 0)


def test_kafka_source_is_an_option(spark):
    # The connector is not on the class path here; the reader is still built for it.
    with pytest.raises(Exception, match="(?i)kafka"):
        L.lineage_stream(spark, **{"kafka.bootstrap.servers": "none:9092", "subscribe": "lineage"})


def test_lines_with_every_kind_of_escape(spark):
    from quadrille.sources import rdf

    lines = [
        (r'<s> <p> "x" . # it is "quoted"', "x"), (r'<s> <p> "a\\" .', "a\\"), (r'<s> <p> "a\\\"b" .', 'a\\"b'), (r'<s> <p> "\U0001F600\u00e9" .', "😀é"),
        (r'<s> <p> "it\'s \\\'" .', "it's \\'"), (r'<s> <p> "\\n\n\t" .', "\\n\n\t"), (r'<s> <p> "\\\\u0041 \uD800" .', r"\\u0041 \uD800"), ('<s> <p> "" .', ""),
        (r'<s> <p> "x\\"@en <g> . # "c"', "x\\")]
    df = spark.createDataFrame([(v,) for v, _ in lines], "value string")
    assert sorted(r["object"] for r in rdf.parse_lines(df).collect()) == sorted(o for _, o in lines)
    quads = spark.createDataFrame([("s", "p", o, "literal", None, None, None) for _, o in lines], rdf.QUAD_DDL)
    back = rdf.parse_lines(rdf.render_quads(quads).withColumnRenamed("line", "value"))
    assert sorted(r["object"] for r in back.collect()) == sorted(o for _, o in lines)
    odd = spark.createDataFrame([("<s> <p> \"open",), ("words",), ("# fine",), ("  ",), ("<s> <p> <o> .",)], "value string")
    assert sorted(r["line"] for r in rdf.unreadable_lines(odd).collect()) == ['<s> <p> "open', "words"]


def test_merge_ties_have_one_outcome(spark):
    from quadrille.sources import tables

    old = spark.createDataFrame([(1, 5, "a")], "k int, c int, v string")
    new = [(1, 5, "b"), (1, 5, "d"), (1, 5, "c")]
    for order in (new, new[::-1]):
        got = tables.merge_rows(old, spark.createDataFrame(order, "k int, c int, v string"), ["k"], "c").collect()
        assert [tuple(r) for r in got] == [(1, 5, "d")]


def test_rows_beyond_the_watermark_are_not_counted(spark, tmp_path):
    from datetime import datetime

    from quadrille.streaming import lineage as L

    landed, schema = str(tmp_path / "landed"), "ts timestamp, tenant_id string"
    for batch in ([datetime(2024, 1, 1, 12, 0), datetime(2024, 1, 1, 13, 0)], [datetime(2024, 1, 1, 12, 55)],
                  [datetime(2024, 1, 1, 13, 1), datetime(2024, 1, 1, 12, 30)], [datetime(2024, 1, 1, 12, 55)]):
        spark.createDataFrame([(ts, "t") for ts in batch], schema).coalesce(1).write.mode("append").parquet(landed)
    counts = L.request_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed))
    L.start_updates(counts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["minute"].strftime("%H:%M"): r["requests"] for r in L.latest_updates(spark, str(tmp_path / "out"), counts.schema, ["minute", "tenant_id"]).collect()}
    # 12:30 came when the watermark had passed it, 12:55 both times before.
    assert got == {"12:00": 1, "13:00": 1, "12:55": 2, "13:01": 1}
