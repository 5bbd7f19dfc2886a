"""Governance queries (Q1-Q10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import columns as C
from quadrille.operators import governance as G
from quadrille.plans.kg import quads, sql_quads
from quadrille.plans.registry import query

ROLES = ["owner", "reviewer", "buyer", "planner", "driver", "student", "keeper", "visitor"]
CONTEXTS = ["orders", "stock", "routes", "lessons", "prices"]
RULES = [("owner", None, None), ("reviewer", "read", None), ("buyer", "read", "orders"), ("buyer", "read", "prices"), ("planner", "read", "stock"),
         ("driver", "read", "routes"), ("student", "read", "lessons"), ("keeper", "read", None), ("keeper", "write", None)]
LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

REQUESTS_SQL = f"""requests AS (SELECT event_id, {LIST(ROLES)}[1 + user_id % 8] AS role, {LIST(CONTEXTS)}[1 + event_id % 5] AS context,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS action,
    {LIST(G.CLEARANCES)}[1 + event_id % 5] AS clearance, event_type AS policy FROM events)"""


def _requests(t):
    pick = lambda values, col: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(col) % len(values) + 1).cast("int"))
    return t.events.select(
        "event_id", pick(ROLES, "user_id").alias("role"), pick(CONTEXTS, "event_id").alias("context"),
        F.when(F.col("event_type").isin("purchase", "signup"), "write").otherwise("read").alias("action"),
        pick(G.CLEARANCES, "event_id").alias("clearance"), F.col("event_type").alias("policy"))


@query("q1_access_decisions", f"""
    WITH {REQUESTS_SQL}
    SELECT event_id, role, action, context,
           COALESCE(CASE role WHEN 'owner' THEN TRUE WHEN 'reviewer' THEN action = 'read' WHEN 'keeper' THEN action IN ('read', 'write')
             WHEN 'buyer' THEN action = 'read' AND context IN ('orders', 'prices') WHEN 'planner' THEN action = 'read' AND context = 'stock'
             WHEN 'driver' THEN action = 'read' AND context = 'routes' WHEN 'student' THEN action = 'read' AND context = 'lessons' END, FALSE) AS allow
    FROM requests""")
def _(t):
    return G.decide(_requests(t).select("event_id", "role", "action", "context"), RULES)


@query("q2_policy_and_clearance", f"""
    WITH {REQUESTS_SQL}
    SELECT event_id, policy, role, action, clearance,
           CASE WHEN policy NOT IN ('click', 'view', 'purchase') OR policy = 'view' OR event_id % 7 = 0 THEN FALSE
                WHEN action = 'read' THEN role IN ('reviewer', 'planner') AND list_position({LIST(G.CLEARANCES)}, clearance) >= 3
                ELSE role IN ('owner') AND list_position({LIST(G.CLEARANCES)}, clearance) >= 3 END AS allow
    FROM (SELECT event_id, policy, role, action, CASE WHEN event_id % 7 = 0 THEN 'secret-ish' ELSE clearance END AS clearance FROM requests)""")
def _(t):
    # The policy of views names a level that there is not, and so do some readers: both deny.
    policies = t.spark.createDataFrame(
        [(p, ["reviewer", "planner"], ["owner"], level) for p, level in (("click", "confidential"), ("view", "high"), ("purchase", "confidential"))],
        "policy string, read array<string>, write array<string>, required string")
    requests = _requests(t).withColumn("clearance", F.when(F.col("event_id") % 7 == 0, "secret-ish").otherwise(F.col("clearance")))
    return G.decide_by_policy(requests.select("event_id", "policy", "role", "action", "clearance"), policies)


@query("q3_row_filters", """
    SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100 AND c_nationkey < 20""")
def _(t):
    df = G.row_filter(t.customer, "planner", "BUILDING", {"c_mktsegment": "{{tenant}}"},
                      {"planner": "c_acctbal > 100 AND c_mktsegment = {{tenant}}", "visitor": "1 = 0"})
    return G.row_filter(df, "planner", "BUILDING", predicates={"planner": "c_nationkey < 20"}).select("c_custkey", "c_name")


@query("q4_pii_masking", """
    SELECT 'low' AS reader, c_custkey, '***' AS customer_name, '***' AS phone, c_acctbal FROM customer
    UNION ALL SELECT 'high', c_custkey, c_name, c_mktsegment, c_acctbal FROM customer""")
def _(t):
    df = t.customer.select("c_custkey", F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("phone"), "c_acctbal")
    fields = ["customer_name", "phone", "nickname"]
    low = G.mask(df, "student", "internal", fields).withColumn("reader", F.lit("low"))
    return low.unionByName(G.mask(df, "student", "restricted", fields).withColumn("reader", F.lit("high")))


@query("q5_tenant_isolation", f"""
    WITH g AS (SELECT *, 'kg://' || CASE WHEN predicate LIKE '%name' THEN 'acme' WHEN predicate LIKE '%segment' THEN 'global'
                      WHEN predicate LIKE '%balance' THEN 'acme-two' ELSE 'other' END || '/instance/x' AS owner FROM ({sql_quads()}))
    SELECT owner, COUNT(*) AS triples FROM g WHERE starts_with(owner, 'kg://acme/') OR starts_with(owner, 'kg://global/') GROUP BY 1""")
def _(t):
    p = F.col("predicate")
    owner = F.when(p.endswith("name"), "acme").when(p.endswith("segment"), "global").when(p.endswith("balance"), "acme-two").otherwise("other")
    q = quads(t).withColumn("owner", F.concat(F.lit("kg://"), owner, F.lit("/instance/x")))
    return G.own_graphs(q, "acme", "owner").groupBy("owner").agg(F.count("*").alias("triples"))


@query("q6_region_restriction", """
    SELECT n_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'
    UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("region"))
    return G.region_filter(places, "EUROPE").unionByName(G.region_filter(places, None))


@query("q7_field_visibility", "SELECT c_custkey, c_mktsegment, '***' AS c_name FROM customer")
def _(t):
    policies = [G.FieldPolicy("c_acctbal", ("finance",)), G.FieldPolicy("c_nationkey", clearance="confidential")]
    df = G.visible_fields(t.customer, policies, "risk", "internal")
    return G.visible_fields(df, [G.FieldPolicy("c_name", clearance="restricted")], "risk", "internal", masked=True)


@query("q8_retention", """
    SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-06-30')
      AND NOT (o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-06-30') AND NOT (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-06-30')""")
def _(t):
    years = {"F": 6, "O": 3, "P": 4}
    return G.retain(t.orders, "o_orderstatus", "o_orderdate", F.lit("2001-06-30").cast("date"), years).select("o_orderkey")


@query("q9_consent", """
    SELECT 'routes' AS context, COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'orders', COUNT(*) FROM orders""")
def _(t):
    consents = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    parts = [G.consented(t.orders, "o_custkey", consents, c, ["routes"]).agg(F.count("*").alias("n")).withColumn("context", F.lit(c))
             for c in ("routes", "orders")]
    return parts[0].unionByName(parts[1])


@query("q10_query_hash", """
    SELECT event_id, left(sha256(event_type || '|' || props), 16) AS query_hash FROM events""")
def _(t):
    return t.events.select("event_id", C.query_hash(F.col("event_type"), F.col("props")).alias("query_hash"))
