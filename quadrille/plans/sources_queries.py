"""Sources, sinks and column mapping."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrille import vocab
from quadrille.functions import columns as C
from quadrille.operators import documents as D
from quadrille.plans.audit_queries import LOG_SQL, audit_log
from quadrille.plans.kg import ONT, RES, quads, sql_quads
from quadrille.plans.registry import query
from quadrille.session import scratch_path
from quadrille.sources import rdf, tables
from quadrille.vocab import FHIR, TYPE, XSD


@query("s1_csv_source", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")
def _(t):
    path = scratch_path(t.spark, "csv")
    t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", True).csv(path)
    return tables.read_csv(t.spark, path)


@query("s2_parquet_source", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 450000")
def _(t):
    df = tables.read_parquet(t.spark, f"{t.sf_dir}/orders.parquet")
    return df.filter("o_totalprice > 450000").select("o_orderkey", "o_totalprice", "o_orderdate")


@query("s3_database_tables", """
    SELECT c_custkey, c_name, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey > (SELECT COUNT(*) // 2 FROM customer)""")
def _(t):
    # Two tables go to a database and are read back from the cursor on, one of them by four tasks. The embedded
    # database lives in one process; on a cluster name one that all machines reach.
    url = t.spark.conf.get("spark.quadrille.jdbc", f"jdbc:derby:memory:db{uuid.uuid4().hex};create=true")
    count = t.customer.count()
    names = {"customers": t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), "nations": t.nation.select("n_nationkey", "n_name")}
    for name, df in names.items():
        df.select([F.col(c).alias(c.upper()) for c in df.columns]).coalesce(1).write.mode("overwrite").jdbc(url, name.upper())
    customers = tables.read_jdbc(t.spark, url, ["CUSTOMERS"], cursor="C_CUSTKEY", since=count // 2, partition_column="C_CUSTKEY", partitions=4,
                                 bounds=(0, count))["CUSTOMERS"]
    nations = tables.read_jdbc(t.spark, url, ["NATIONS"])["NATIONS"]
    return customers.join(nations, F.col("C_NATIONKEY") == F.col("N_NATIONKEY")).select(
        F.col("C_CUSTKEY").alias("c_custkey"), F.col("C_NAME").alias("c_name"), F.col("C_ACCTBAL").alias("c_acctbal"), F.col("N_NAME").alias("n_name"))


@query("s4_api_pages", "SELECT event_id, event_type, value FROM events")
def _(t):
    # A page is an event object, a bare list, or an object with the list under "data".
    row = F.struct("event_id", "event_type", "value")
    body = (F.when(F.col("event_type") == "view", F.to_json(F.array(row)))
            .otherwise(F.to_json(F.struct(F.array(row).alias("data"), F.lit("/next").alias("next")))))
    return tables.page_records(t.events.select(body.alias("value")), "event_id: bigint, event_type: string, value: double")


@query("s4_unreadable_pages", """
    SELECT CASE event_type WHEN 'error' THEN 'no json' ELSE 'no list' END AS fault, COUNT(*) AS pages FROM events
    WHERE event_type IN ('error', 'signup', 'purchase') GROUP BY 1""")
def _(t):
    # Cut short, records that are none, a text in their place; views and clicks are whole, or an object without records.
    e, row = F.col("event_type"), F.struct("event_id", "event_type", "value")
    whole = F.to_json(F.struct(F.array(row).alias("data")))
    body = (F.when(e == "error", F.substring(whole, F.lit(1), F.length(whole) - 3)).when(e == "signup", '{"data": {"id": 1}}').when(e == "purchase", '"text"')
            .when(e == "view", '{"status": "empty"}').otherwise(whole))
    lost = tables.page_faults(t.events.select(body.alias("value")), "event_id: bigint, event_type: string, value: double")
    return lost.groupBy("fault").agg(F.count("*").alias("pages"))


@query("s5_unreadable_bundles", """
    SELECT CASE event_type WHEN 'error' THEN 'no json' ELSE 'no bundle' END AS fault, COUNT(*) AS bundles FROM events
    WHERE event_type IN ('error', 'view', 'signup') GROUP BY 1""")
def _(t):
    e = F.col("event_type")
    bundle = F.when(e == "error", '{"entry": [{').when(e == "view", '{"entry": 3}').when(e == "signup", '[]').when(e == "click", '{"entry": []}').otherwise(
        F.concat(F.lit('{"entry": [{"resource": {"resourceType": "Device", "id": "'), "event_id", F.lit('"}}]}')))
    return rdf.unreadable_bundles(t.events.select(bundle.alias("value"))).groupBy("fault").agg(F.count("*").alias("bundles"))


@query("s5_fhir_bundles", f"""
    SELECT subject, predicate, object, kind AS object_kind, CAST(dt AS VARCHAR) AS datatype FROM (
    SELECT '{ONT}Patient/' || c_custkey AS subject, '{TYPE}' AS predicate, '{FHIR}Patient' AS object, 'iri' AS kind, NULL AS dt FROM customer
    UNION ALL SELECT '{ONT}Patient/' || c_custkey, '{FHIR}birthDate', '1990-01-02', 'literal', '{XSD}date' FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT '{ONT}Patient/' || c_custkey, '{FHIR}name', 'Ann Bo ' || c_name, 'literal', NULL FROM customer
    UNION ALL SELECT '{ONT}Observation/' || o_orderkey, p, o, k, d FROM orders, LATERAL (VALUES ('{TYPE}', '{FHIR}Observation', 'iri', NULL),
        ('{FHIR}status', 'final', 'literal', NULL), ('{FHIR}subject', '{ONT}Patient/' || o_custkey, 'iri', NULL),
        ('{FHIR}valueQuantity', CAST(o_custkey AS VARCHAR) || '.5', 'literal', '{XSD}decimal')) v(p, o, k, d)
    UNION ALL SELECT '{ONT}Device/' || s_suppkey, '{TYPE}', '{FHIR}Device', 'iri', NULL FROM supplier)""")
def _(t):
    bundle = lambda *f: F.to_json(F.struct(F.lit("Bundle").alias("resourceType"), F.array(F.struct(F.struct(*f).alias("resource"))).alias("entry")))
    kind = lambda n: F.lit(n).alias("resourceType")
    patients = t.customer.select(bundle(
        kind("Patient"), F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_acctbal") > 0, "1990-01-02").alias("birthDate"),
        F.array(F.struct(F.array(F.lit("Ann"), F.lit("Bo")).alias("given"), F.col("c_name").alias("family"))).alias("name")).alias("value"))
    observations = t.orders.select(bundle(
        kind("Observation"), F.col("o_orderkey").cast("string").alias("id"), F.lit("final").alias("status"),
        F.struct(F.concat(F.lit("#Patient/"), "o_custkey").alias("reference")).alias("subject"),
        F.struct((F.col("o_custkey") + 0.5).alias("value")).alias("valueQuantity")).alias("value"))
    others = t.supplier.select(bundle(kind("Device"), F.col("s_suppkey").cast("string").alias("id")).alias("value"))
    return rdf.fhir_to_triples(patients.union(observations).union(others)).drop("lang", "graph")


@query("s6_rdf_xml", f"""
    SELECT subject, predicate, object, kind AS object_kind, CAST(dt AS VARCHAR) AS datatype FROM (
    SELECT '#part' || p_partkey AS subject, p AS predicate, o AS object, k AS kind, d AS dt FROM part, LATERAL (VALUES
        ('{TYPE}', '{vocab.CIM}Breaker', 'iri', NULL), ('{vocab.CIM}IdentifiedObject.name', p_name, 'literal', NULL),
        ('{vocab.CIM}Equipment.size', CAST(p_size AS VARCHAR), 'literal', '{XSD}integer'),
        ('{vocab.CIM}Equipment.EquipmentContainer', '#brand' || substr(p_brand, 7), 'iri', NULL)) v(p, o, k, d))""")
def _(t):
    xml = F.format_string(
        f'<rdf:RDF xmlns:rdf="{vocab.RDF}" xmlns:cim="{vocab.CIM}"><cim:Breaker rdf:ID="part%d">'
        '<cim:IdentifiedObject.name>%s</cim:IdentifiedObject.name>'
        f'<cim:Equipment.size rdf:datatype="{XSD}integer">%d</cim:Equipment.size>'
        '<cim:Equipment.EquipmentContainer rdf:resource="#brand%s"/></cim:Breaker></rdf:RDF>',
        "p_partkey", "p_name", "p_size", F.substring("p_brand", 7, 10))
    return rdf.rdfxml_to_triples(t.part.select(xml.alias("value"))).drop("lang", "graph")


@query("s7_json_ld", f"""
    SELECT '{RES}customer/' || c_custkey AS subject, p AS predicate, o AS object, k AS object_kind, CAST(d AS VARCHAR) AS datatype,
           CAST(l AS VARCHAR) AS lang FROM customer, LATERAL (VALUES
        ('{TYPE}', '{ONT}Account', 'iri', NULL, NULL), ('{ONT}name', c_name, 'literal', NULL, 'en'), ('{ONT}key', CAST(c_custkey AS VARCHAR), 'literal', '{XSD}integer', NULL),
        ('{ONT}inNation', '{RES}nation/' || c_nationkey, 'iri', NULL, NULL), ('{ONT}debtor', CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END, 'literal', '{XSD}boolean', NULL)
        ) v(p, o, k, d, l)""")
def _(t):
    context = F.struct(F.lit(ONT).alias("o"), F.lit(RES).alias("r"), F.struct(F.lit("o:inNation").alias("@id"), F.lit("@id").alias("@type")).alias("nation"))
    doc = F.to_json(F.struct(context.alias("@context"), F.array(F.struct(
        F.concat(F.lit("r:customer/"), "c_custkey").alias("@id"), F.lit("o:Account").alias("@type"),
        F.struct(F.col("c_name").alias("@value"), F.lit("en").alias("@language")).alias("o:name"), F.col("c_custkey").alias("o:key"),
        F.concat(F.lit("r:nation/"), "c_nationkey").alias("nation"), (F.col("c_acctbal") < 0).alias("o:debtor"))).alias("@graph")))
    return rdf.jsonld_to_triples(t.customer.select(doc.alias("value"))).drop("graph")


@query("s8_ntriples_round_trip", f"""
    SELECT subject, predicate, object, object_kind, datatype, lang, graph FROM ({sql_quads('customer', 'supplier')})
    UNION ALL SELECT '{RES}doc/' || doc_id, '{ONT}text', text, 'literal', NULL, lang, NULL FROM documents""")
def _(t):
    # Whole texts, with quotes, backslashes and line breaks, survive the escaping.
    from quadrille.operators.triples import explode_quads, quad

    texts = explode_quads(t.documents, [quad(F.concat(F.lit(RES + "doc/"), "doc_id"), ONT + "text", F.col("text"), lang=F.col("lang"))])
    path = scratch_path(t.spark, "lines")
    rdf.write_ntriples(quads(t, "customer", "supplier").unionByName(texts), path)
    return rdf.read_ntriples(t.spark, path)


@query("s8_unreadable_lines", """
    SELECT CASE event_type WHEN 'view' THEN 'no end' ELSE 'no predicate' END AS fault, COUNT(*) AS n FROM events WHERE event_type IN ('view', 'error') GROUP BY 1""")
def _(t):
    e, subject = F.col("event_type"), F.concat(F.lit("<http://e/"), "event_id", F.lit("> "))
    line = (F.when(e == "view", F.concat(subject, F.lit('<http://p> "open'))).when(e == "error", F.concat(subject, F.lit('"value" .')))
            .when(e == "click", F.concat(subject, F.lit('<http://p> "a\\"b\\\\" . # said \"so\"'))).otherwise(F.lit("# nothing but a comment")))
    lost = rdf.unreadable_lines(t.events.select(line.alias("value")))
    fault = F.when(F.col("line").contains("<http://p>"), "no end").otherwise("no predicate")
    return lost.groupBy(fault.alias("fault")).agg(F.count("*").alias("n"))


@query("s9_write_replace_and_merge", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS version FROM customer
    UNION ALL SELECT -1 - s_suppkey, s_acctbal, 2 FROM supplier""")
def _(t):
    path = scratch_path(t.spark, "table")
    first = t.customer.select("c_custkey", "c_acctbal", F.lit(1).alias("version"))
    tables.write_table(first, path)
    changed = first.filter("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.lit(2).alias("version"))
    stale = first.filter("c_acctbal > 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal"), F.lit(0).alias("version"))
    added = t.supplier.select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit(2).alias("version"))
    tables.write_table(changed.unionByName(stale).unionByName(added), path, "merge", ["c_custkey"], "version")
    return t.spark.read.schema(first.schema).parquet(path)


@query("s9_bucketed_merge", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS version FROM customer
    UNION ALL SELECT -1 - s_suppkey, s_acctbal, 2 FROM supplier""")
def _(t):
    path = scratch_path(t.spark, "buckets")
    first = t.customer.select("c_custkey", "c_acctbal", F.lit(1).alias("version"))
    tables.merge_buckets(first, path, ["c_custkey"], "version", 16)
    changed = first.filter("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.lit(2).alias("version"))
    stale = first.filter("c_acctbal > 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal"), F.lit(0).alias("version"))
    added = t.supplier.select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit(2).alias("version"))
    tables.merge_buckets(changed.unionByName(stale).unionByName(added), path, ["c_custkey"], "version")
    return tables.read_buckets(t.spark, path, first.schema).drop("_bucket")


@query("s10_incremental_load", """
    SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT MAX(o_orderdate) FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01')""")
def _(t):
    loaded = t.orders.filter(F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp_ntz"))
    # The state is a scalar subquery: no value passes through the driver.
    last = tables.cursor_state(loaded, "o_orderdate").scalar()
    return tables.incremental(t.orders, "o_orderdate", last).select("o_orderkey", "o_orderdate")


@query("s12_load_statistics", """
    SELECT 'orders' AS "table", COUNT(*) AS "rows" FROM orders UNION ALL SELECT 'customer', COUNT(*) FROM customer
    UNION ALL SELECT '*', (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM customer)""")
def _(t):
    return tables.load_stats({"orders": t.orders, "customer": t.customer})


@query("s12_load_report", """
    SELECT 'orders' AS "table", COUNT(*) AS "rows", NULL AS seen, FALSE AS timed FROM orders UNION ALL SELECT 'customer', COUNT(*), NULL, FALSE FROM customer
    UNION ALL SELECT '*', (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM customer), 'customer,orders', TRUE""")
def _(t):
    from datetime import datetime, timezone

    report = tables.load_report({"orders": t.orders, "customer": t.customer}, datetime.now(timezone.utc))
    return report.select("table", "rows", F.array_join("seen", ",").alias("seen"), F.coalesce(F.col("seconds").between(0, 3600), F.lit(False)).alias("timed"))


@query("s13_append_only_audit", f"""
    WITH {LOG_SQL} SELECT tenant_id, COUNT(*) AS n, COUNT(DISTINCT id) AS ids FROM log GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "audit")
    log = audit_log(t)
    tables.append_audit(log.filter("action = 'query'"), path)
    tables.append_audit(log.filter("action <> 'query'"), path)
    stored = t.spark.read.schema(log.schema).parquet(path)
    return stored.groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("p1_column_mapping", """
    SELECT o_orderkey AS transaction_id, o_totalprice AS amount, o_orderpriority = '1-URGENT' AS flagged, o_orderstatus AS status,
           'https://class/Amount' AS _class_amount FROM orders""")
def _(t):
    raw = t.orders.withColumn("urgent", F.when(F.col("o_orderpriority") == "1-URGENT", "1").otherwise("0"))
    return C.map_columns(raw, [
        C.ColumnMap("o_orderkey", "transaction_id", "integer"), C.ColumnMap("o_totalprice", "amount", "float", annotation="https://class/Amount"),
        C.ColumnMap("urgent", "flagged", "boolean"), C.ColumnMap("o_orderstatus", "status")])


@query("p2_lenient_cast", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS amount FROM events""")
def _(t):
    text = F.when(F.col("event_type") == "view", F.concat(F.lit("x"), "value")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", C.lenient(text).alias("amount"))


PAYMENT = {"STANDARD": "wire", "MEDIUM": "ach", "PROMO": "cash", "SMALL": "check"}


@query("p3_value_map", """
    SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'wire' WHEN 'MEDIUM' THEN 'ach' WHEN 'PROMO' THEN 'cash' WHEN 'SMALL' THEN 'check' END AS kind FROM part""")
def _(t):
    return t.part.select("p_partkey", C.value_map(F.col("p_type"), PAYMENT).alias("kind"))


@query("p4_step_to_time", """
    SELECT p_partkey, TIMESTAMP '2024-01-01' + to_hours(p_size) AS at_hour, TIMESTAMP '2024-01-01' + to_days(p_size) AS at_day FROM part""")
def _(t):
    size = F.col("p_size")
    return t.part.select("p_partkey", C.step_to_timestamp(size, "2024-01-01").alias("at_hour"),
                         C.step_to_timestamp(size, "2024-01-01", "days").alias("at_day"))


@query("p5_identifier_templates", """
    SELECT 'prefix:account-' || c_custkey AS account, 'https://b/customer/' || c_nationkey || '/' || c_custkey AS subject FROM customer""")
def _(t):
    return t.customer.select(C.template("prefix:account-{c_custkey}").alias("account"),
                             C.subject_template("https://b/", "customer", ["c_nationkey", "c_custkey"]).alias("subject"))


@query("p6_deterministic_ids", """
    WITH n AS (SELECT event_id, 'aml-' || (ROW_NUMBER() OVER (ORDER BY event_id) - 1) || '-' || event_type AS name FROM events),
    h AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) AS d FROM n)
    SELECT event_id, left(d, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
           substr('89ab', 1 + (('0x' || substr(d, 17, 1))::INT & 3), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS transaction_id FROM h""")
def _(t):
    return C.row_ids(t.events.select("event_id", "event_type"), ["event_id"], "event_type").select("event_id", "transaction_id")


@query("p13_curies_and_local_names", f"""
    SELECT c_custkey, 'skos:' || c_mktsegment AS curie, '{vocab.SKOS}' || c_mktsegment AS iri, c_mktsegment AS name FROM customer""")
def _(t):
    iri = F.concat(F.lit(vocab.SKOS), "c_mktsegment")
    prefixes = {**vocab.PREFIXES, "kg": ONT}
    curie = C.compact_iri(iri, prefixes)
    return t.customer.select("c_custkey", curie.alias("curie"), C.expand_curie(curie, prefixes).alias("iri"), C.local_name(iri).alias("name"))


@query("p14_term_kinds", """
    SELECT page_id, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN 'iri' ELSE 'literal' END AS url_kind,
           'literal' AS page_kind FROM pages""")
def _(t):
    return t.pages.select("page_id", C.term_kind(F.col("url")).alias("url_kind"), C.term_kind(F.col("html")).alias("page_kind"))


@query("p15_flags", """
    SELECT event_id, event_type IN ('click', 'view', 'error') AS flag FROM events""")
def _(t):
    e = F.col("event_type")
    marker = F.when(e == "click", "1").when(e == "view", "True").when(e == "error", " true ").when(e == "signup", "0")
    return t.events.select("event_id", C.flag(marker).alias("flag"))


@query("s11_html_source", """
    SELECT page_id, 'text/html' AS mime_type, length(html) > 0 AS has_text FROM pages""")
def _(t):
    named = t.pages.select("page_id", F.concat(F.lit("file:"), "page_id", F.lit(".html")).alias("path"), "html")
    parsed = D.parse_pages(named.withColumn("mime_type", D.mime_type(F.col("path"))))
    return parsed.select("page_id", "mime_type", (F.length("text") > 0).alias("has_text"))
