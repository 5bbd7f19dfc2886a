"""Shape validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille import vocab
from quadrille.operators import shapes as S
from quadrille.operators import triples as T
from quadrille.operators.metrics import EntitySpec, PropertySpec
from quadrille.plans.kg import ONT, RES, graph, quads, sql_quads
from quadrille.plans.registry import query
from quadrille.vocab import TYPE, XSD

CUSTOMER, TX, LINE = ONT + "Account", ONT + "FinancialTransaction", ONT + "Line"


def _lines(t):
    """Lines share an identifier when order and line number repeat: multi-valued properties."""
    mapping = T.RowMapping(RES + "line/{l_orderkey}/{l_linenumber}", (LINE,), (
        T.Field("l_extendedprice", ONT + "price", XSD + "decimal"),
        T.Field("l_returnflag", ONT + "flag"),
        T.Field("note", ONT + "note"),
    ), (T.Link(ONT + "ofOrder", RES + "order/{l_orderkey}"),))
    return T.rows_to_triples(
        t.lineitem.withColumn("note", F.when(F.col("l_tax") > 0, F.col("l_linestatus"))), mapping, "lines")


LINE_KEY = f"'{RES}line/' || l_orderkey || '/' || l_linenumber"


def _violation(cls: str, **kw) -> S.Shape:
    return S.Shape(cls, shape="CheckedShape", **kw)


def _only(t, source, shape):
    return S.validate(source, [shape]).select("focus", "path", "value", "component")


@query("v1_focus_nodes", f"""
    SELECT '{RES}customer/' || c_custkey AS focus, '{ONT}Agent' AS class FROM customer
    UNION ALL SELECT '{RES}customer/' || c_custkey, '{CUSTOMER}' FROM customer""")
def _(t):
    q = quads(t).unionByName(T.explode_quads(t.spark.range(1), [
        T.quad(F.lit(CUSTOMER), vocab.SUBCLASS, F.lit(ONT + "Agent"), "iri", graph="schema")]))
    return S.focus_nodes(q, [ONT + "Agent", CUSTOMER])


@query("v2_min_count", f"""
    SELECT {LINE_KEY} AS focus, '{ONT}note' AS path, CAST(NULL AS VARCHAR) AS value, 'minCount' AS component
    FROM lineitem GROUP BY 1 HAVING MAX(l_tax) = 0""")
def _(t):
    return _only(t, _lines(t), _violation(LINE, path=ONT + "note", min_count=1))


@query("v2_max_count", f"""
    SELECT {LINE_KEY} AS focus, '{ONT}price' AS path, CAST(NULL AS VARCHAR) AS value, 'maxCount' AS component
    FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_extendedprice) > 1""")
def _(t):
    return _only(t, _lines(t), _violation(LINE, path=ONT + "price", max_count=1))


@query("v3_datatype", f"""
    SELECT '{RES}order/' || o_orderkey AS focus, '{ONT}amount' AS path,
           CAST(o_totalprice AS VARCHAR) AS value, 'datatype' AS component FROM orders""")
def _(t):
    # Amounts are decimals, so none of them is an integer.
    return _only(t, graph(t, "orders"), _violation(TX, path=ONT + "amount", datatype=XSD + "integer"))


@query("v4_pattern", f"""
    SELECT '{RES}customer/' || c_custkey AS focus, '{ONT}name' AS path, c_name AS value, 'pattern' AS component
    FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$')""")
def _(t):
    return _only(t, graph(t, "customer"), _violation(CUSTOMER, path=ONT + "name", pattern="^Customer#[0-9]*[02468]$"))


@query("v5_in", f"""
    SELECT '{RES}customer/' || c_custkey AS focus, '{ONT}segment' AS path, c_mktsegment AS value, 'in' AS component
    FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def _(t):
    return _only(t, graph(t, "customer"), _violation(CUSTOMER, path=ONT + "segment", values=("BUILDING", "MACHINERY")))


@query("v6_class", f"""
    SELECT DISTINCT {LINE_KEY} AS focus, '{ONT}ofOrder' AS path, '{RES}order/' || l_orderkey AS value, 'class' AS component
    FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def _(t):
    settled = T.rows_to_triples(t.orders.filter("o_orderstatus = 'F'"),
                                T.RowMapping(RES + "order/{o_orderkey}", (TX,)), "orders")
    return _only(t, _lines(t).unionByName(settled), _violation(LINE, path=ONT + "ofOrder", node_class=TX))


@query("v7_node_kind", f"""
    SELECT '{RES}customer/' || c_custkey AS focus, '{ONT}name' AS path, c_name AS value, 'nodeKind' AS component FROM customer""")
def _(t):
    return _only(t, graph(t, "customer"), _violation(CUSTOMER, path=ONT + "name", node_kind="BlankNodeOrIRI"))


SHAPES = [
    S.Shape(TX, ONT + "transactionId", 1, 1, XSD + "integer"),
    S.Shape(TX, ONT + "amount", 1, 1, XSD + "decimal"),
    S.Shape(TX, ONT + "currency", 1, 1, vocab.XSD + "string", pattern="^[A-Z]{3}$", values=("EUR", "USD")),
    S.Shape(TX, ONT + "timestamp", 1, 1, XSD + "dateTime"),
    S.Shape(TX, ONT + "isSuspicious", None, 1, XSD + "boolean"),
    S.Shape(TX, ONT + "fromAccount", 1, None, node_class=CUSTOMER, node_kind="IRI"),
    S.Shape(TX, ONT + "purpose", 1, None, message="a purpose is required", severity="Warning"),
    S.Shape(CUSTOMER, ONT + "segment", 1, 1, values=("BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE")),
    S.Shape(CUSTOMER, ONT + "balance", None, 1, XSD + "decimal", pattern="^[0-9]"),
]

REPORT_SQL = f"""
    SELECT '{RES}order/' || o_orderkey AS focus, '{ONT}currency' AS path, 'GBP' AS value, 'FinancialTransactionShape' AS shape,
           'in' AS component, 'constraint in not met on {ONT}currency' AS message, 'Violation' AS severity
    FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT '{RES}order/' || o_orderkey, '{ONT}fromAccount', '{RES}customer/' || o_custkey, 'FinancialTransactionShape',
           'class', 'constraint class not met on {ONT}fromAccount', 'Violation'
    FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT '{RES}order/' || o_orderkey, '{ONT}purpose', NULL, 'FinancialTransactionShape', 'minCount',
           'a purpose is required', 'Warning' FROM orders
    UNION ALL SELECT '{RES}customer/' || c_custkey, '{ONT}segment', c_mktsegment, 'AccountShape', 'in',
           'constraint in not met on {ONT}segment', 'Violation' FROM customer
           WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE', 'AUTOMOBILE')
    UNION ALL SELECT '{RES}customer/' || c_custkey, '{ONT}balance', CAST(c_acctbal AS VARCHAR),
           'AccountShape', 'pattern', 'constraint pattern not met on {ONT}balance', 'Violation' FROM customer WHERE c_acctbal < 0"""


def report(t):
    return S.validate(graph(t), SHAPES)


@query("v8_shape_report", REPORT_SQL)
def _(t):
    return report(t)


@query("v9_quarantine_triples", f"""
    SELECT predicate, object, object_kind, graph, COUNT(*) AS n FROM (
        SELECT '{TYPE}' AS predicate, '{vocab.SH}ValidationResult' AS object, 'iri' AS object_kind FROM ({REPORT_SQL})
        UNION ALL SELECT '{vocab.SH}focusNode', focus, 'iri' FROM ({REPORT_SQL})
        UNION ALL SELECT '{vocab.SH}resultMessage', message, 'literal' FROM ({REPORT_SQL})), (VALUES ('held')) v(graph)
    GROUP BY 1, 2, 3, 4""")
def _(t):
    held = S.quarantine_triples(report(t), "held")
    return held.groupBy("predicate", "object", "object_kind", "graph").agg(F.count("*").alias("n"))


@query("v9_quarantine_split", f"""
    WITH bad AS (SELECT DISTINCT focus FROM ({REPORT_SQL}) WHERE severity = 'Violation')
    SELECT graph, CASE WHEN subject IN (SELECT focus FROM bad) THEN 'held' ELSE 'kept' END AS part, COUNT(*) AS triples
    FROM ({sql_quads()}) GROUP BY 1, 2""")
def _(t):
    flagged = S.flag_quarantine(quads(t), report(t))
    part = F.when(F.col("quarantined"), "held").otherwise("kept").alias("part")
    return flagged.groupBy("graph", part).agg(F.count("*").alias("triples"))


@query("v10_table_validation", """
    SELECT CAST(o_orderkey AS VARCHAR) AS key, 'status' AS property, 'allowed' AS component, o_orderstatus AS value
    FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'priority', 'pattern', o_orderpriority FROM orders
    WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'priority', 'type', o_orderpriority FROM orders WHERE TRUE
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'owner', 'required', NULL FROM orders WHERE o_orderpriority = '5-LOW'
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'customer', 'reference', CAST(o_custkey AS VARCHAR) FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def _(t):
    spec = EntitySpec("Order", "orders", (
        PropertySpec("status", "o_orderstatus", allowed=("F", "O")),
        PropertySpec("priority", "o_orderpriority", "integer", pattern="^[1-4]-"),
        PropertySpec("owner", "owner", nullable=False),
        PropertySpec("customer", "o_custkey", "integer", references=("Customer", "c_custkey")),
    ))
    orders = t.orders.withColumn("owner", F.when(F.col("o_orderpriority") != "5-LOW", F.lit("desk")))
    customers = t.customer.filter("c_mktsegment <> 'BUILDING'")
    return S.validate_table(orders, spec, "o_orderkey", {"customer": (customers, "c_custkey")})


@query("v11_violation_counts", f"""
    SELECT shape, path, component, COUNT(*) AS violations FROM ({REPORT_SQL}) GROUP BY 1, 2, 3""")
def _(t):
    return S.violation_counts(report(t))


@query("v11_violation_rates", f"""
    WITH total AS (SELECT 'FinancialTransactionShape' AS shape, COUNT(*) AS nodes FROM orders
                   UNION ALL SELECT 'AccountShape', COUNT(*) FROM customer)
    SELECT r.shape, path, COUNT(DISTINCT focus) AS failing, ANY_VALUE(nodes) AS nodes, COUNT(DISTINCT focus) / ANY_VALUE(nodes) AS rate
    FROM ({REPORT_SQL}) r JOIN total ON r.shape = total.shape GROUP BY 1, 2""")
def _(t):
    return S.violation_rates(report(t), graph(t), SHAPES)
