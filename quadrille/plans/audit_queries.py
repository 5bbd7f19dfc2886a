"""Provenance, lineage, audit and change-tracking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import columns as C
from quadrille.operators import audit as A
from quadrille.plans.kg import ONT, RES
from quadrille.plans.registry import SCHEMAS, query
from quadrille.vocab import PROV, TYPE, XSD



def number():
    """The number in an event's JSON."""
    return F.get_json_object("props", "$.k").cast("int")


K_SQL = "CAST(props ->> '$.k' AS INT)"
HASH_SQL = "left(sha256('q' || event_id), 16)"
ISO_SQL = "replace(CAST({} AS VARCHAR), ' ', 'T')"


def audit_log(t):
    """Events as audit rows: the user's bucket is the tenant, the JSON number the context."""
    e = F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"),
        F.concat(F.lit("u"), "user_id").alias("user_id"),
        F.when(e.isin("click", "view", "error"), "query").when(e == "purchase", "export").otherwise("login").alias("action"),
        F.when(e == "error", "error").when((e == "purchase") & (F.col("value") > 100), "denied").otherwise("success").alias("status"),
        F.when(e != "signup", F.concat(F.lit("c"), (number() / 10).cast("int"))).alias("context"), F.col("ts").alias("created_at"))


LOG_SQL = f"""log AS (SELECT event_id AS id, 't' || (user_id % 7) AS tenant_id, 'u' || user_id AS user_id,
    CASE WHEN event_type IN ('click', 'view', 'error') THEN 'query' WHEN event_type = 'purchase' THEN 'export' ELSE 'login' END AS action,
    CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' AND value > 100 THEN 'denied' ELSE 'success' END AS status,
    CASE WHEN event_type <> 'signup' THEN 'c' || ({K_SQL} // 10) END AS context, ts AS created_at FROM events)"""


def query_runs(t):
    """Events as query runs that used one graph and produced one result."""
    start = F.col("ts")
    return t.events.select(
        F.substring(F.sha2(F.concat(F.lit("q"), "event_id"), 256), 1, 16).alias("query_hash"),
        F.concat(F.lit("t"), F.col("user_id") % 7).alias("tenant_id"), F.col("event_type").alias("context"),
        F.lit(None).cast("string").alias("query_text"), F.concat(F.lit(RES + "user/"), "user_id").alias("user_iri"),
        F.array(F.concat(F.lit(RES + "graph/"), number())).alias("used_graphs"),
        F.when(F.col("event_type") != "error", F.concat(F.lit(RES + "result/"), "event_id")).alias("result_iri"),
        start.alias("started_at"), (start + F.expr("INTERVAL 1 SECOND")).alias("ended_at"))


def prov_quads(t, predicates=None):
    """Query provenance, and the derivation of every result from its graph's dataset."""
    runs = A.query_triples(query_runs(t), "prov", predicates=predicates)
    derived = t.events.filter("event_type <> 'error'").select(
        F.concat(F.lit(RES + "result/"), "event_id").alias("entity_iri"), F.concat(F.lit(RES + "dataset/"), (number() / 10).cast("int")).alias("source_iri"),
        F.concat(F.lit(RES + "prov/query/"), F.substring(F.sha2(F.concat(F.lit("q"), "event_id"), 256), 1, 16)).alias("activity_iri"))
    return runs.unionByName(A.derivation_triples(derived, "prov", predicates))


def prov_source(t):
    """The same as a function of the predicates wanted, so that a pattern makes its own quads only."""
    return lambda predicates: prov_quads(t, predicates)


ACTIVITY_SQL = f"'{RES}prov/query/' || {HASH_SQL}"
START_SQL = ISO_SQL.format("ts")
END_SQL = ISO_SQL.format("ts + INTERVAL 1 SECOND")
RUN_TRIPLES_SQL = f"""
    SELECT {ACTIVITY_SQL} AS subject, p AS predicate, o AS object, k AS object_kind, CAST(d AS VARCHAR) AS datatype,
           CAST(NULL AS VARCHAR) AS lang, 'prov' AS graph, event_id FROM events, LATERAL (VALUES
        ('{TYPE}', '{PROV}Activity', 'iri', NULL), ('{PROV}startedAtTime', {START_SQL}, 'literal', '{XSD}dateTime'),
        ('{PROV}endedAtTime', {END_SQL}, 'literal', '{XSD}dateTime'), ('{ONT}queryHash', {HASH_SQL}, 'literal', NULL),
        ('{ONT}context', event_type, 'literal', NULL), ('{ONT}tenantId', 't' || (user_id % 7), 'literal', NULL),
        ('{PROV}wasAssociatedWith', '{RES}user/' || user_id, 'iri', NULL), ('{PROV}used', '{RES}graph/' || {K_SQL}, 'iri', NULL),
        ('{PROV}generated', CASE WHEN event_type <> 'error' THEN '{RES}result/' || event_id END, 'iri', NULL)) v(p, o, k, d)
    WHERE o IS NOT NULL"""
DERIVED_SQL = f"""
    SELECT '{RES}result/' || event_id AS subject, p AS predicate, o AS object, 'iri' AS object_kind, CAST(NULL AS VARCHAR) AS datatype,
           CAST(NULL AS VARCHAR) AS lang, 'prov' AS graph, event_id FROM events, LATERAL (VALUES
        ('{TYPE}', '{PROV}Entity'), ('{PROV}wasDerivedFrom', '{RES}dataset/' || ({K_SQL} // 10)), ('{PROV}wasGeneratedBy', {ACTIVITY_SQL})) v(p, o)
    WHERE event_type <> 'error'"""
QUAD = "subject, predicate, object, object_kind, datatype, lang, graph"


@query("l1_query_activity_triples", f"SELECT {QUAD} FROM ({RUN_TRIPLES_SQL})")
def _(t):
    return A.query_triples(query_runs(t), "prov")


CONTEXT_SQL = f"json_object('prov', '{PROV}', 'xsd', '{XSD}', 'kg', '{ONT}')"


@query("l1_query_activity_documents", f"""
    SELECT {HASH_SQL} AS query_hash, CAST(CASE WHEN event_type <> 'error' THEN
        json_object('@context', {CONTEXT_SQL}, '@id', {ACTIVITY_SQL}, '@type', 'prov:Activity',
            'prov:startedAtTime', json_object('@value', {START_SQL}, '@type', 'xsd:dateTime'),
            'prov:endedAtTime', json_object('@value', {END_SQL}, '@type', 'xsd:dateTime'), 'kg:queryHash', {HASH_SQL}, 'kg:context', event_type,
            'prov:wasAssociatedWith', json_object('@id', '{RES}user/' || user_id), 'prov:used', json_array(json_object('@id', '{RES}graph/' || {K_SQL})),
            'prov:generated', json_object('@id', '{RES}result/' || event_id))
        ELSE json_object('@context', {CONTEXT_SQL}, '@id', {ACTIVITY_SQL}, '@type', 'prov:Activity',
            'prov:startedAtTime', json_object('@value', {START_SQL}, '@type', 'xsd:dateTime'),
            'prov:endedAtTime', json_object('@value', {END_SQL}, '@type', 'xsd:dateTime'), 'kg:queryHash', {HASH_SQL}, 'kg:context', event_type,
            'prov:wasAssociatedWith', json_object('@id', '{RES}user/' || user_id), 'prov:used', json_array(json_object('@id', '{RES}graph/' || {K_SQL})))
        END AS VARCHAR) AS document FROM events""")
def _(t):
    return A.query_documents(query_runs(t))


def _jobs(t):
    """One ingestion run per supplier: the lines it delivered are the triples added."""
    per = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("triples_added"), F.min("l_shipdate").alias("started_at"),
                                              F.max("l_shipdate").alias("ended_at"))
    return per.select(
        F.col("l_suppkey").cast("string").alias("job_id"), F.concat(F.lit("file:lines/"), "l_suppkey").alias("source_iri"),
        F.lit(RES + "tenant/acme").alias("tenant_iri"), "triples_added", F.lit("v1").alias("ontology_version"),
        F.lit(None).cast("string").alias("extraction_model"), F.concat(F.lit("kg://acme/instance/lines/"), "l_suppkey").alias("named_graph_iri"),
        "started_at", "ended_at")


@query("l2_ingestion_triples", f"""
    WITH j AS (SELECT l_suppkey, COUNT(*) AS n, MIN(l_shipdate) AS a, MAX(l_shipdate) AS b FROM lineitem GROUP BY 1)
    SELECT '{RES}prov/ingest/' || l_suppkey AS subject, p AS predicate, o AS object, k AS object_kind, CAST(d AS VARCHAR) AS datatype,
           CAST(NULL AS VARCHAR) AS lang, 'prov' AS graph FROM j, LATERAL (VALUES
        ('{TYPE}', '{PROV}Activity', 'iri', NULL), ('{PROV}startedAtTime', {ISO_SQL.format('a')}, 'literal', '{XSD}dateTime'),
        ('{PROV}endedAtTime', {ISO_SQL.format('b')}, 'literal', '{XSD}dateTime'), ('{PROV}used', 'file:lines/' || l_suppkey, 'iri', NULL),
        ('{PROV}wasAssociatedWith', '{RES}tenant/acme', 'iri', NULL), ('{ONT}triplesAdded', CAST(n AS VARCHAR), 'literal', '{XSD}integer'),
        ('{ONT}ontologyVersion', 'v1', 'literal', NULL), ('{PROV}generated', 'kg://acme/instance/lines/' || l_suppkey, 'iri', NULL)) v(p, o, k, d)""")
def _(t):
    return A.ingestion_triples(_jobs(t), "prov")


@query("l2_ingestion_documents", f"""
    WITH j AS (SELECT l_suppkey, COUNT(*) AS n, MIN(l_shipdate) AS a, MAX(l_shipdate) AS b FROM lineitem GROUP BY 1)
    SELECT CAST(l_suppkey AS VARCHAR) AS job_id, CAST(json_object('@context', {CONTEXT_SQL}, '@id', '{RES}prov/ingest/' || l_suppkey, '@type', 'prov:Activity',
        'prov:startedAtTime', json_object('@value', {ISO_SQL.format('a')}, '@type', 'xsd:dateTime'),
        'prov:endedAtTime', json_object('@value', {ISO_SQL.format('b')}, '@type', 'xsd:dateTime'),
        'prov:used', json_object('@id', 'file:lines/' || l_suppkey), 'prov:wasAssociatedWith', json_object('@id', '{RES}tenant/acme'),
        'kg:triplesAdded', n, 'kg:ontologyVersion', 'v1', 'prov:generated', json_object('@id', 'kg://acme/instance/lines/' || l_suppkey)) AS VARCHAR) AS document
    FROM j""")
def _(t):
    return A.ingestion_documents(_jobs(t))


@query("l3_derivation_triples", f"SELECT {QUAD} FROM ({DERIVED_SQL})")
def _(t):
    return prov_quads(t).filter(F.col("subject").startswith(RES + "result/"))


@query("l3_derivation_documents", f"""
    SELECT '{RES}user/' || u AS entity_iri, '{RES}graph/' || k AS source_iri,
        CAST(json_object('@context', {CONTEXT_SQL}, '@id', '{RES}user/' || u, '@type', 'prov:Entity',
        'prov:wasDerivedFrom', to_json([{{'@id': '{RES}graph/' || k}}]),
        'prov:wasGeneratedBy', json_object('@id', 'urn:run')) AS VARCHAR) AS document FROM (SELECT DISTINCT user_id AS u, {K_SQL} AS k FROM events)""")
def _(t):
    return A.derivation_documents(t.events.select(
        F.concat(F.lit(RES + "user/"), "user_id").alias("entity_iri"), F.concat(F.lit(RES + "graph/"), number()).alias("source_iri"),
        F.lit("urn:run").alias("activity_iri")))


@query("l4_provenance_chain", f"""
    SELECT '{RES}result/' || event_id AS entity, {ACTIVITY_SQL} AS activity, '{RES}user/' || user_id AS agent, {END_SQL} AS time,
           '{RES}graph/' || {K_SQL} AS source FROM events WHERE event_type <> 'error'""")
def _(t):
    return A.provenance_chain(prov_source(t))


@query("l5_lineage_trace", f"""
    SELECT '{RES}graph/' || {K_SQL} AS entity, {ACTIVITY_SQL} AS activity, '{RES}user/' || user_id AS agent, {START_SQL} AS start_time,
           {END_SQL} AS end_time FROM events""")
def _(t):
    return A.lineage_trace(prov_source(t))


@query("l5_lineage_trace_one", f"""
    SELECT '{RES}graph/42' AS entity, {ACTIVITY_SQL} AS activity, '{RES}user/' || user_id AS agent, {START_SQL} AS start_time, {END_SQL} AS end_time
    FROM events WHERE {K_SQL} = 42 ORDER BY start_time DESC, activity LIMIT 100""")
def _(t):
    return A.lineage_trace(prov_source(t), RES + "graph/42")


@query("l6_transitive_lineage", f"""
    SELECT '{RES}result/' || event_id AS entity, o AS origin, d AS depth FROM events, LATERAL (VALUES
        ({ACTIVITY_SQL}, 1), ('{RES}dataset/' || ({K_SQL} // 10), 1), ('{RES}graph/' || {K_SQL}, 2)) v(o, d) WHERE event_type <> 'error'""")
def _(t):
    results = t.events.filter("event_type <> 'error'").select(F.concat(F.lit(RES + "result/"), "event_id").alias("entity"))
    return A.transitive_lineage(prov_source(t), results)


@query("l7_provenance_by_hash", f"""
    SELECT {QUAD} FROM ({RUN_TRIPLES_SQL} UNION ALL {DERIVED_SQL}) WHERE event_id IN (SELECT event_id FROM events WHERE event_type = 'purchase')""")
def _(t):
    hashes = query_runs(t).filter("context = 'purchase'").select("query_hash")
    return A.provenance_by_hash(prov_source(t), hashes)


@query("l8_export_window", f"""
    WITH q AS ({RUN_TRIPLES_SQL})
    SELECT '<' || subject || '> <' || predicate || '> ' || CASE WHEN object_kind = 'iri' THEN '<' || object || '>'
           ELSE '"' || object || '"' || COALESCE('^^<' || datatype || '>', '') END || ' <prov> .' AS line
    FROM q JOIN events USING (event_id) WHERE user_id % 7 = 3 AND {START_SQL} >= '2024-01-05T00:00:00' AND {START_SQL} <= '2024-01-20T12:00:00'""")
def _(t):
    from quadrille.sources.rdf import render_quads

    return render_quads(A.export_window(prov_quads(t), "t3", "2024-01-05T00:00:00", "2024-01-20T12:00:00"))


@query("l8_export_window_jsonld", f"""
    WITH q AS ({RUN_TRIPLES_SQL})
    SELECT '{{"@id":"prov","@graph":[{{"@id":"' || subject || '","' || predicate || '":{{' || CASE WHEN object_kind = 'iri' THEN '"@id":"' || object || '"'
           ELSE '"@value":"' || object || '"' || COALESCE(',"@type":"' || datatype || '"', '') END || '}}}}]}}' AS line
    FROM q JOIN events USING (event_id) WHERE user_id % 7 = 3 AND {START_SQL} >= '2024-01-05T00:00:00' AND {START_SQL} <= '2024-01-20T12:00:00'""")
def _(t):
    from quadrille.sources.rdf import render_jsonld

    return render_jsonld(A.export_window(prov_quads(t), "t3", "2024-01-05T00:00:00", "2024-01-20T12:00:00"))


@query("l9_audit_listing", f"""
    WITH {LOG_SQL} SELECT * FROM log WHERE tenant_id = 't3' AND action = 'query' AND status = 'success'
      AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 20""")
def _(t):
    return A.list_audit(audit_log(t), tenant_id="t3", action="query", status="success", date_from="2024-01-05", date_to="2024-01-25",
                        limit=100, offset=20)


@query("l10_audit_statistics", f"""
    WITH {LOG_SQL}
    SELECT 'total' AS measure, NULL AS name, COUNT(*) AS count FROM log
    UNION ALL SELECT 'action', action, COUNT(*) FROM log GROUP BY 2 UNION ALL SELECT 'status', status, COUNT(*) FROM log GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'user', user_id, COUNT(*) AS n FROM log GROUP BY 2 ORDER BY n DESC, user_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'context', context, COUNT(*) AS n FROM log WHERE context IS NOT NULL GROUP BY 2 ORDER BY n DESC, context LIMIT 10)""")
def _(t):
    return A.audit_statistics(audit_log(t))


def lineage_json(t):
    """Events as lineage messages: purchases complete, errors fail, signups start; views are unreadable."""
    e = F.col("event_type")
    message = F.to_json(F.struct(
        F.when(e == "purchase", "complete").when(e == "error", "FAIL").when(e == "signup", "START").otherwise("OTHER").alias("eventType"),
        C.iso_time(F.col("ts")).alias("eventTime"),
        F.struct(F.lit("ns").alias("namespace"), F.concat(F.lit("job"), number()).alias("name")).alias("job"),
        F.struct(F.concat(F.lit("run"), "event_id").alias("runId"), F.struct(F.struct(
            F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("t"), F.col("user_id") % 7)).alias("tenant_id"),
            F.lit("structured").alias("source_type")).alias("ingestion")).alias("facets")).alias("run")))
    return t.events.select("event_id", F.when(e == "view", "{not json").otherwise(message).alias("value"))


AUDIT_FROM_LINEAGE_SQL = f"""
    SELECT CASE WHEN user_id % 2 = 0 THEN 't' || (user_id % 7) ELSE 'unknown' END AS tenant_id, 'ingest' AS action,
           CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'started' END AS status,
           'job' || {K_SQL} AS context, 'run' || event_id AS query_hash, ts AS created_at
    FROM events WHERE event_type IN ('purchase', 'error', 'signup')"""


@query("l11_lineage_to_audit", AUDIT_FROM_LINEAGE_SQL)
def _(t):
    return A.lineage_to_audit(lineage_json(t)).drop("prov_jsonld", "metadata").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("l11_unreadable_events", "SELECT event_id FROM events WHERE event_type = 'view'")
def _(t):
    return A.unreadable_events(lineage_json(t)).select("event_id")


@query("l12_snapshot_drift", """
    SELECT * FROM (VALUES ('o_orderkey', 'same'), ('o_custkey', 'retyped'), ('o_orderstatus', 'removed'), ('o_totalprice', 'same'),
        ('o_orderdate', 'same'), ('o_orderpriority', 'same'), ('channel', 'added')) v("column", change)
    LEFT JOIN (SELECT 'o_totalprice' AS "column", COUNT_IF(o_totalprice > 400000) / COUNT(*) AS null_rate_change,
               COUNT(DISTINCT CASE WHEN o_totalprice <= 400000 THEN o_totalprice END) - COUNT(DISTINCT o_totalprice) AS distinct_change FROM orders
               UNION ALL SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderdate', 'o_orderpriority']), 0.0, 0) s USING ("column")""")
def _(t):
    after = (t.orders.drop("o_orderstatus").withColumn("o_custkey", F.col("o_custkey").cast("string"))
             .withColumn("o_totalprice", F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice")))
             .withColumn("channel", F.lit("web")))
    return A.drift(t.orders, after, exact=True).select("column", "change", "null_rate_change", "distinct_change")


@query("l13_version_diff", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'removed' WHEN c_mktsegment = 'BUILDING' THEN 'modified' END AS change FROM customer
    WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING' UNION ALL SELECT -1 - c_custkey, 'added' FROM customer WHERE c_acctbal > 9000""")
def _(t):
    kept = t.customer.filter("c_acctbal >= 0").withColumn(
        "c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    new = t.customer.filter("c_acctbal > 9000").withColumn("c_custkey", -1 - F.col("c_custkey"))
    return A.version_diff(t.customer, kept.unionByName(new), ["c_custkey"])


@query("l14_key_profile", " UNION ALL ".join(
    f"SELECT 'orders' AS \"table\", '{c}' AS \"column\", COUNT(*) AS \"rows\", COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS \"distinct\", "
    f"COUNT(*) = COUNT(DISTINCT {c}) AS candidate FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def _(t):
    return A.key_profile(t.orders, "orders")


@query("l14_reference_profile", """
    SELECT 'lineitem.l_orderkey' AS name, COUNT(*) AS "values", COUNT(*) - COUNT(o_orderkey) AS missing, COUNT(*) = COUNT(o_orderkey) AS included
    FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'events.user_id', COUNT(*), COUNT(*) - COUNT(s_suppkey), COUNT(*) = COUNT(s_suppkey)
    FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN supplier ON user_id = s_suppkey""")
def _(t):
    return A.reference_profile(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "lineitem.l_orderkey").unionByName(
        A.reference_profile(t.events, "user_id", t.supplier, "s_suppkey", "events.user_id"))


NUMBERS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
           "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
           "events": ["event_id", "user_id"], "documents": ["doc_id", "n_chars"], "embeddings": ["vec_id", "label"], "pages": ["page_id"],
           "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn"]}
TEXTS = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
         "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
         "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"]}
CELLS_SQL = " UNION ALL ".join(f"SELECT '{t}.{c}' AS c, '{k}' AS k, CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 3"
                               for k, columns in (("number", NUMBERS), ("text", TEXTS)) for t, names in columns.items() for c in names)


@query("l14_discovered_references", f"""
    WITH cells AS ({CELLS_SQL}), total AS (SELECT c, COUNT(*) AS d, MAX(n) AS most FROM cells GROUP BY 1)
    SELECT x.c AS dependent, y.c AS referenced, COUNT(*) AS "values" FROM cells x JOIN cells y ON x.k = y.k AND x.v = y.v AND x.c <> y.c
    JOIN total tx ON tx.c = x.c JOIN total ty ON ty.c = y.c AND ty.most = 1 GROUP BY x.c, y.c, tx.d HAVING COUNT(*) = tx.d""")
def _(t):
    # Every column of whole numbers or text of every table at once.
    return A.discovered_references({name: t[name] for name in SCHEMAS})


def indicators(t):
    e = F.col("event_type")
    return t.events.select("ts", (e == "error").alias("is_error"), (e == "click").alias("is_hit"), (e == "view").alias("is_miss"),
                           F.when(e == "purchase", number()).otherwise(0).alias("ingested"))


INDICATOR_SQL = f"""
    SELECT window_start, COUNT(*) AS requests, COUNT_IF(event_type = 'error') / COUNT(*) AS error_rate,
           CASE WHEN COUNT_IF(event_type IN ('click', 'view')) > 0 THEN COUNT_IF(event_type = 'click') / COUNT_IF(event_type IN ('click', 'view')) END AS hit_rate,
           SUM(CASE WHEN event_type = 'purchase' THEN {K_SQL} ELSE 0 END) / {{seconds}} AS ingested_per_second,
           COUNT_IF(event_type = 'error') / COUNT(*) > 0.05 AS high_error_rate,
           COALESCE(COUNT_IF(event_type = 'click') / NULLIF(COUNT_IF(event_type IN ('click', 'view')), 0) < 0.7, FALSE) AS low_hit_rate
    FROM {{source}} GROUP BY 1"""


@query("l15_service_indicators", INDICATOR_SQL.format(
    seconds=3600, source="(SELECT *, date_trunc('hour', ts) AS window_start FROM events)"))
def _(t):
    return A.service_indicators(indicators(t), window="1 hour")


@query("l15_usage_by_context", f"""
    WITH {LOG_SQL} SELECT context, date_trunc('day', created_at) AS day, COUNT(*) AS requests, COUNT(DISTINCT user_id) AS users FROM log GROUP BY 1, 2""")
def _(t):
    day = F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")
    return audit_log(t).groupBy("context", day).agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("users"))
