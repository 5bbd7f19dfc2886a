"""The named end-to-end results (Z1-Z8) over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import metrics as M
from quadrille.plans.model import MODEL
from quadrille.plans.registry import query

# Transfers run from the supplier to the customer of the order; the return flag
# marks the suspicious ones, and the line status stands for the currency.
CURRENCY_SQL = "CASE l_linestatus WHEN 'F' THEN 'EUR' ELSE 'USD' END"


def _dec(name: str):
    return F.col(name).cast("decimal(18,4)")


@query("z1_exposure_by_counterparty", f"""
    SELECT s_name AS bank_name, n_name AS jurisdiction,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total_exposure,
           COUNT(*) AS transaction_count,
           ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*), 4) AS avg_transaction_size
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    WHERE {CURRENCY_SQL} = 'EUR'
    GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20""")
def exposure(t):
    # Aggregated per supplier key before the join: one row per counterparty
    # crosses the network, whatever share of the lines a counterparty holds.
    per_bank = (t.lineitem.filter(F.col("l_linestatus") == "F")
                .groupBy("l_suppkey").agg(F.sum(_dec("l_extendedprice")).alias("s"), F.count("*").alias("n")))
    return (per_bank.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("s_name").alias("bank_name"), F.col("n_name").alias("jurisdiction"))
            .agg(F.sum("s").cast("double").alias("total_exposure"), F.sum("n").alias("transaction_count"))
            .withColumn("avg_transaction_size", F.round(F.col("total_exposure") / F.col("transaction_count"), 4))
            .orderBy(F.desc("total_exposure"), "bank_name").limit(20))


@query("z2_connected_accounts", """
    WITH x AS (SELECT l_suppkey AS a, o_custkey AS b, CAST(l_extendedprice AS DECIMAL(18,4)) AS amount
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
    u AS (SELECT 's' || a AS source, 'c' || b AS connected, 'outbound' AS connection_type, amount FROM x
          UNION ALL SELECT 'c' || b, 's' || a, 'inbound', amount FROM x)
    SELECT source, connected, connection_type, COUNT(*) AS suspicious_count, CAST(SUM(amount) AS DOUBLE) AS suspicious_amount
    FROM u GROUP BY 1, 2, 3 ORDER BY 4 DESC, 5 DESC, 1, 2, 3 LIMIT 50""")
def _(t):
    pairs = (t.lineitem.filter(F.col("l_returnflag") == "R")
             .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy("l_suppkey", "o_custkey")
             .agg(F.count("*").alias("suspicious_count"), F.sum(_dec("l_extendedprice")).alias("amount")))
    # Both directions carry the same totals: aggregate once, then emit each
    # pair twice. The two directions never share a key.
    seller, buyer = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("c"), "o_custkey")
    both = F.array(
        F.struct(seller.alias("source"), buyer.alias("connected"), F.lit("outbound").alias("connection_type")),
        F.struct(buyer.alias("source"), seller.alias("connected"), F.lit("inbound").alias("connection_type")))
    return (pairs.select(F.inline(both), "suspicious_count", F.col("amount").cast("double").alias("suspicious_amount"))
            .orderBy(F.desc("suspicious_count"), F.desc("suspicious_amount"), "source", "connected", "connection_type")
            .limit(50))


@query("z3_suspicious_transfers", f"""
    SELECT l_orderkey AS order_key, l_linenumber AS line, l_shipdate AS shipped_at, s_name AS from_name, c_name AS to_name,
           l_extendedprice AS amount, {CURRENCY_SQL} AS currency, l_partkey AS part_key, l_quantity AS quantity
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    WHERE l_returnflag = 'R' AND {CURRENCY_SQL} = 'EUR' AND l_extendedprice > 100000
    ORDER BY amount DESC, shipped_at, order_key, line, part_key, quantity LIMIT 100""")
def _(t):
    order = [F.desc("amount"), F.asc("shipped_at"), F.asc("order_key"), F.asc("line"), F.asc("part_key"), F.asc("quantity")]
    # The names are optional and unique per key, so the top 100 can be taken
    # before the left joins that add them.
    top = (t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
                             & (F.col("l_extendedprice") > 100000))
           .select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
                   F.col("l_shipdate").alias("shipped_at"), "l_suppkey", F.col("l_extendedprice").alias("amount"),
                   F.lit("EUR").alias("currency"), F.col("l_partkey").alias("part_key"),
                   F.col("l_quantity").alias("quantity"))
           .orderBy(*order).limit(100))
    return (top.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("from_name")),
                     "l_suppkey", "left")
            .join(t.orders.select(F.col("o_orderkey").alias("order_key"), "o_custkey"), "order_key", "left")
            .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("to_name")),
                  "o_custkey", "left")
            .select("order_key", "line", "shipped_at", "from_name", "to_name", "amount", "currency", "part_key", "quantity")
            .orderBy(*order))


@query("z4_suspicious_volume_by_bank", """
    SELECT l_suppkey AS from_bank, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total_suspicious_amount,
           COUNT(*) AS transaction_count
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t):
    return (t.lineitem.filter(F.col("l_returnflag") == "R").groupBy(F.col("l_suppkey").alias("from_bank"))
            .agg(F.sum(_dec("l_extendedprice")).cast("double").alias("total_suspicious_amount"),
                 F.count("*").alias("transaction_count"))
            .orderBy(F.desc("total_suspicious_amount"), "from_bank").limit(20))


@query("z5_volume_by_type_and_period", """
    SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, o_orderpriority AS priority,
           o_orderstatus AS status, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS volume
    FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3""")
def _(t):
    spec = M.MetricSpec("volume", "sum", "Order", "amount", default_filter="o.o_orderstatus != 'P'",
                        time_grains=("month",), time_column="o_orderdate")
    df = M.metric(spec, MODEL, t, ["priority", "status"], grain="month")
    return df.withColumn("volume", F.col("volume").cast("double"))


@query("z6_suspicious_count_by_counterparty", """
    SELECT c_name AS buyer, p_type AS kind, COUNT(*) AS suspicious FROM lineitem
    LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN part ON l_partkey = p_partkey
    WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def _(t):
    spec = M.MetricSpec(
        "suspicious", "count", "Line", "amount", default_filter="t.l_returnflag = 'R'",
        dimensions=(M.Dimension("buyer", "Customer", "name", via=("order_key", "customer")),
                    M.Dimension("kind", "Part", "kind")))
    return M.metric(spec, MODEL, t)


@query("z7_load_factor_by_region", """
    SELECT r_name AS region,
           ROUND(SUM(CAST(l_quantity AS DECIMAL(18,4)) / NULLIF(CAST(p_size AS DECIMAL(18,4)), 0)) / COUNT(*), 3) AS load_factor
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _(t):
    rated = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    line = M.EntitySpec("Measurement", "measurements", (
        M.PropertySpec("supplier_key", "l_suppkey", "integer", references=("Supplier", "supplier_key")),))
    spec = M.MetricSpec("load_factor", "avg", "Measurement", measure_sql="l_quantity / nullif(p_size, 0)",
                        dimensions=(M.Dimension("region", "Region", "name"),))
    model = M.Model({**MODEL.entities, "Measurement": line})
    df = M.metric(spec, model, {**{n: t[n] for n in ("supplier", "nation", "region")}, "measurements": rated})
    return df.withColumn("load_factor", F.round("load_factor", 3))


@query("z8_equipment_effectiveness", """
    SELECT p_brand AS line, ROUND(AVG((1 - l_discount) * (1 - l_tax) * (l_quantity / 50) * 100), 4) AS effectiveness,
           ROUND(SUM(epoch(l_shipdate) - epoch(o_orderdate)) / 3600, 2) AS elapsed_hours,
           ROUND(AVG(l_quantity / NULLIF(p_size, 0)), 4) AS throughput
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    facts = (t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
             .join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey"))
    asset = M.EntitySpec("Asset", "facts", (M.PropertySpec("line", "p_brand"),))
    model, tables = M.Model.of(asset), {"facts": facts}
    hours = "(unix_timestamp(cast(l_shipdate as timestamp)) - unix_timestamp(cast(o_orderdate as timestamp))) / 3600"
    specs = {
        "effectiveness": ("avg", "(1 - l_discount) * (1 - l_tax) * (l_quantity / 50) * 100", 4),
        "elapsed_hours": ("sum", hours, 2),
        "throughput": ("avg", "l_quantity / nullif(p_size, 0)", 4),
    }
    df = M.metric_set([M.MetricSpec(n, kind, "Asset", measure_sql=sql) for n, (kind, sql, _) in specs.items()],
                      model, tables, ["line"])
    return df.withColumns({n: F.round(n, digits) for n, (_, _, digits) in specs.items()})
