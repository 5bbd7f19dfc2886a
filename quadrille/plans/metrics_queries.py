"""Metric queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quadrille.functions import columns as C
from quadrille.operators import metrics as M
from quadrille.plans.model import BUYER_NATION, EXPOSURE, MODEL, SELLER_NATION, SELLER_REGION
from quadrille.plans.registry import query

LINES = M.MetricSpec("volume", "sum", "Line", "amount", time_grains=M.GRAINS, time_column="l_shipdate")


def _double(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _kind(kind: str, measure: str = "amount") -> M.MetricSpec:
    return M.MetricSpec(f"{kind}_value", kind, "Line", measure)


@query("m1_metric_sum", """
    SELECT l_returnflag AS flag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_value
    FROM lineitem GROUP BY 1""")
def _(t):
    return _double(M.metric(_kind("sum"), MODEL, t, ["flag"]), "sum_value")


@query("m1_metric_exact_values", """
    SELECT l_returnflag AS flag, CAST(SUM(CAST(l_quantity AS DECIMAL(10,2)) * CAST('0.000000123' AS DECIMAL(9,9))) AS VARCHAR) AS small,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(20,2)) * CAST(1000000000000 AS DECIMAL(14,0))) AS VARCHAR) AS large FROM lineitem GROUP BY 1""")
def _(t):
    # Nine decimals and more, sums beyond 1e15: a plain decimal keeps the type of its column.
    entity = M.EntitySpec("Fine", "fine", (M.PropertySpec("small", "small", "decimal"), M.PropertySpec("large", "large", "decimal"), M.PropertySpec("flag", "l_returnflag")))
    fine = t.lineitem.select("l_returnflag", F.expr("cast(l_quantity AS decimal(10,2)) * cast('0.000000123' AS decimal(9,9))").alias("small"),
                             F.expr("cast(l_extendedprice AS decimal(20,2)) * cast(1000000000000 AS decimal(14,0))").alias("large"))
    each = [M.metric(M.MetricSpec(n, "sum", "Fine", n), M.Model.of(entity), {"fine": fine}, ["flag"]).withColumn(n, F.col(n).cast("string")) for n in ("small", "large")]
    return each[0].join(each[1], "flag")


@query("m1_metric_count", "SELECT l_returnflag AS flag, COUNT(l_extendedprice) AS count_value FROM lineitem GROUP BY 1")
def _(t):
    return M.metric(_kind("count"), MODEL, t, ["flag"])


@query("m1_metric_avg", """
    SELECT l_returnflag AS flag, ROUND(AVG(l_extendedprice), 3) AS avg_value FROM lineitem GROUP BY 1""")
def _(t):
    df = M.metric(_kind("avg"), MODEL, t, ["flag"])
    return df.withColumn("avg_value", F.round(F.col("avg_value").cast("double"), 3))


@query("m1_metric_min_max", """
    SELECT l_linestatus AS status, MIN(l_extendedprice) AS min_value, MAX(l_extendedprice) AS max_value
    FROM lineitem GROUP BY 1""")
def _(t):
    df = M.metric_set([_kind("min"), _kind("max")], MODEL, t, ["status"])
    return _double(df, "min_value", "max_value")


@query("m1_metric_count_distinct", """
    SELECT l_returnflag AS flag, COUNT(DISTINCT l_orderkey) AS count_distinct_value FROM lineitem GROUP BY 1""")
def _(t):
    return M.metric(_kind("count_distinct", "order_key"), MODEL, t, ["flag"])


@query("m2_metric_custom", """
    SELECT l_returnflag AS flag,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(1 - l_discount AS DECIMAL(6,2))) AS DOUBLE)
               AS discounted
    FROM lineitem GROUP BY 1""")
def _(t):
    spec = M.MetricSpec("discounted", "custom", "Line",
                        measure_sql="sum(cast(l_extendedprice as decimal(18,4)) * cast(1 - l_discount as decimal(6,2)))")
    return _double(M.metric(spec, MODEL, t, ["flag"]), "discounted")


@query("m3_metric_latest", """
    SELECT event_type, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1""")
def _(t):
    entity = M.EntitySpec("Reading", "readings", (M.PropertySpec("event_type", "event_type"),))
    spec = M.MetricSpec("last_value", "latest", "Reading", "value", time_column="at")
    readings = t.events.withColumn("at", F.struct("ts", "event_id"))
    return M.metric(spec, M.Model.of(entity), {"readings": readings}, ["event_type"])


@query("m4_metric_global", """
    SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS volume FROM lineitem""")
def _(t):
    return _double(M.metric(LINES, MODEL, t, []), "volume")


@query("m5_metric_time_grains", " UNION ALL ".join(f"""
    SELECT '{g}' AS grain, CAST(date_trunc('{g}', l_shipdate) AS TIMESTAMP) AS period, l_returnflag AS flag,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS volume
    FROM lineitem GROUP BY 1, 2, 3""" for g in M.GRAINS))
def _(t):
    return _double(M.metric_by_grain(LINES, MODEL, t, ["flag"]), "volume")


@query("m6_metric_cross_entity", """
    SELECT sn.n_name AS seller_nation, sr.r_name AS seller_region, bn.n_name AS buyer_nation,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS exposure
    FROM lineitem
    LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
    LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey
    LEFT JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation bn ON c_nationkey = bn.n_nationkey
    GROUP BY 1, 2, 3""")
def _(t):
    spec = M.MetricSpec("exposure", "sum", "Line", "amount",
                        dimensions=(SELLER_NATION, SELLER_REGION, BUYER_NATION))
    return _double(M.metric(spec, MODEL, t), "exposure")


@query("m6_metric_cross_entity_distinct", """
    SELECT p_brand AS "Part_brand", COUNT(DISTINCT l_suppkey) AS sellers
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    spec = M.MetricSpec("sellers", "count_distinct", "Line", "supplier_key")
    return M.metric(spec, MODEL, t, ["Part.brand"]).withColumnRenamed("Part.brand", "Part_brand")


@query("m7_metric_top_k", """
    SELECT p_brand AS brand, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS exposure
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(t):
    spec = M.MetricSpec("exposure", "sum", "Line", "amount", dimensions=(M.Dimension("brand", "Part", "brand"),))
    return _double(M.metric(spec, MODEL, t, top=10), "exposure")


@query("m8_context_resolution", """
    WITH catalogue AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS metric, l_returnflag AS context FROM lineitem
                       UNION SELECT DISTINCT 'segment-' || c_mktsegment, 'risk' FROM customer),
    requests AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'segment-BUILDING'
                                       WHEN event_type = 'error' THEN 'no-such-metric'
                                       ELSE CAST(user_id AS VARCHAR) END AS metric,
                        CASE WHEN event_type = 'view' THEN 'R' WHEN event_type = 'signup' THEN 'nowhere' END AS requested
                 FROM events),
    per AS (SELECT metric, COUNT(DISTINCT context) AS n, MIN(context) AS only_one FROM catalogue GROUP BY 1)
    SELECT event_id, r.metric, requested,
           CASE WHEN requested IS NOT NULL THEN (SELECT MIN(context) FROM catalogue c WHERE c.context = requested)
                WHEN n = 1 THEN only_one WHEN n IS NULL THEN 'general' END AS context,
           CASE WHEN requested IS NOT NULL AND requested IN (SELECT context FROM catalogue) THEN 'resolved'
                WHEN requested IS NOT NULL THEN 'unknown_context'
                WHEN n = 1 THEN 'inferred' WHEN n > 1 THEN 'ambiguous' ELSE 'default' END AS status,
           COALESCE(n, 0) AS candidates
    FROM requests r LEFT JOIN per ON r.metric = per.metric""")
def _(t):
    catalogue = (t.lineitem.select(F.col("l_suppkey").cast("string").alias("metric"), F.col("l_returnflag").alias("context"))
                 .union(t.customer.select(F.concat(F.lit("segment-"), "c_mktsegment"), F.lit("risk"))))
    requests = t.events.select(
        "event_id",
        F.when(F.col("event_type") == "click", "segment-BUILDING")
        .when(F.col("event_type") == "error", "no-such-metric")
        .otherwise(F.col("user_id").cast("string")).alias("metric"),
        F.when(F.col("event_type") == "view", "R").when(F.col("event_type") == "signup", "nowhere").alias("context"))
    return M.resolve_requests(requests, catalogue, default="general")


@query("m9_contexts_side_by_side", """
    SELECT sn.n_name AS seller_nation, 'risk' AS context, NULL AS flag,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total_exposure
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus IN ('O', 'P')
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
    WHERE l_extendedprice > 0 GROUP BY 1
    UNION ALL
    SELECT sn.n_name, 'finance', l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE)
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey
    WHERE l_linestatus = 'F' AND l_returnflag <> 'R' GROUP BY 1, 3""")
def _(t):
    df = M.metric_by_context(EXPOSURE, MODEL, t, dimensions=["seller_nation"])
    return _double(df, "total_exposure")


# Orders stand in for stays: the customer is the patient and a stay lasts a week.
STAYS_SQL = "SELECT o_orderkey AS stay, o_custkey AS patient, o_orderstatus AS class, o_orderdate AS s, " \
            "o_orderdate + INTERVAL 7 DAY AS e FROM orders"


def _stays(t):
    return t.orders.select(
        F.col("o_orderkey").alias("stay"), F.col("o_custkey").alias("patient"), F.col("o_orderstatus").alias("class"),
        F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("e"))


@query("m10_readmission_30_days", f"""
    WITH stays AS ({STAYS_SQL})
    SELECT a.class, COUNT(DISTINCT a.patient) AS readmitted FROM stays a
    WHERE EXISTS (SELECT 1 FROM stays b WHERE b.patient = a.patient AND b.stay <> a.stay
                  AND b.s >= a.e AND b.s <= a.e + INTERVAL 30 DAY)
    GROUP BY 1""")
def _(t):
    again = M.followed_within(_stays(t), "stay", "patient", "s", "e", 30)
    return again.groupBy("class").agg(F.count_distinct("patient").alias("readmitted"))


@query("j5_interval_join_rows", f"""
    WITH stays AS ({STAYS_SQL})
    SELECT a.stay, a.patient, a.class, a.s, a.e FROM stays a
    WHERE EXISTS (SELECT 1 FROM stays b WHERE b.patient = a.patient AND b.stay <> a.stay
                  AND b.s >= a.e AND b.s <= a.e + INTERVAL 30 DAY)""")
def _(t):
    return M.followed_within(_stays(t), "stay", "patient", "s", "e", 30)


@query("m11_cohort_metric", """
    SELECT o_orderpriority AS priority, COUNT(o_orderkey) AS n FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def _(t):
    cohort = M.in_cohort(t.orders, "o_custkey", t.customer, "c_custkey", "c_mktsegment = 'BUILDING'")
    spec = M.MetricSpec("n", "count", "Order", "order_key")
    return M.metric(spec, MODEL, {**t, "orders": cohort}, ["priority"])


@query("m12_context_extra_dimensions", """
    SELECT l_linestatus AS status, l_returnflag AS flag,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total_exposure
    FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R' GROUP BY 1, 2""")
def _(t):
    return _double(M.metric(EXPOSURE, MODEL, t, ["status", "flag"], context="finance"), "total_exposure")


@query("p7_equality_filters", """
    SELECT l_returnflag AS flag, COUNT(l_extendedprice) AS n FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'O' GROUP BY 1""")
def _(t):
    spec = M.MetricSpec("n", "count", "Line", "amount")
    return M.metric(spec, MODEL, t, ["flag"], filters={"flag": ["A", "R"], "status": "O"})


@query("p8_operator_filters", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
    WHERE l_quantity >= 25 AND l_quantity < 40 AND l_discount > 0.02 AND l_discount <= 0.08
      AND l_returnflag <> 'N' AND l_linestatus = 'F' AND l_linenumber IN (1, 2, 3)""")
def _(t):
    return C.operator_filters(t.lineitem, [
        {"field": "l_quantity", "operator": ">=", "value": 25},
        {"field": "l_quantity", "operator": "<", "value": 40},
        {"field": "l_discount", "operator": ">", "value": 0.02},
        {"field": "l_discount", "operator": "<=", "value": 0.08},
        {"field": "l_returnflag", "operator": "!=", "value": "N"},
        {"field": "l_linestatus", "operator": "=", "value": "F"},
        {"field": "l_linenumber", "operator": "IN", "value": [1, 2, 3]},
    ]).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("p9_time_range", """
    SELECT l_returnflag AS flag, COUNT(l_extendedprice) AS n FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1998-06-30' GROUP BY 1""")
def _(t):
    spec = replace(LINES, name="n", type="count")
    return M.metric(spec, MODEL, t, ["flag"], between=("1997-01-01", "1998-06-30"))


@query("p10_raw_sql_filters", """
    SELECT l_linestatus AS status, COUNT(l_extendedprice) AS n FROM lineitem
    WHERE l_discount > 0.01 AND l_returnflag = 'A' AND l_tax < 0.05 GROUP BY 1""")
def _(t):
    spec = M.MetricSpec("n", "count", "Line", "amount", default_filter="t.l_discount > 0.01",
                        contexts={"risk": M.MetricContext(filter="t.l_returnflag = 'A'")})
    return M.metric(spec, MODEL, t, ["status"], row_filters=["t.l_tax < 0.05"])


@query("p11_context_column", """
    SELECT c_mktsegment AS segment, 'risk' AS context,
           CAST(SUM(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS balance_sum FROM customer GROUP BY 1
    UNION ALL
    SELECT c_mktsegment, 'finance',
           CAST(SUM(CAST(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS DECIMAL(18,4))) AS DOUBLE)
    FROM customer GROUP BY 1""")
def _(t):
    spec = M.MetricSpec("balance_sum", "sum", "Customer", "balance",
                        contexts={"risk": M.MetricContext(), "finance": M.MetricContext()})
    return _double(M.metric_by_context(spec, MODEL, t, dimensions=["segment"]), "balance_sum")


@query("p12_computed_measures", """
    SELECT o_orderkey,
           l_extendedprice / NULLIF(l_quantity, 0) AS unit_price,
           l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
           l_extendedprice / NULLIF(l_linenumber - 1, 0) AS guarded,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days,
           ROUND((epoch(l_shipdate) - epoch(o_orderdate)) / 3600, 4) AS hours
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    df = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return df.select(
        "o_orderkey",
        C.ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
        C.ratio(F.col("l_extendedprice"), F.col("l_linenumber") - 1).alias("guarded"),
        C.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"),
        F.round(C.hours_between(F.col("l_shipdate"), F.col("o_orderdate")), 4).alias("hours"))


@query("f2_sql_expressions", """
    SELECT l_linestatus AS status, CAST(COUNT_IF(l_discount > 0.05) AS BIGINT) AS discounted FROM lineitem
    WHERE l_tax < 0.04 AND l_shipdate > TIMESTAMP '1996-01-01' GROUP BY 1""")
def _(t):
    spec = M.MetricSpec("discounted", "custom", "Line", measure_sql="count_if(l_discount > 0.05)", default_filter="t.l_tax < 0.04",
                        contexts={"late": M.MetricContext(filter="t.l_shipdate > timestamp_ntz'1996-01-01'")})
    return M.metric(spec, MODEL, t, ["status"])
