"""Relational shapes: joins, aggregates, windows, sorts and set operations (J*, A*, W*, O*, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import quality as K
from quadrille.operators import sketches as H
from quadrille.plans.registry import query
from quadrille.session import materialise, scratch_path


@query("j1_inner_join", """
    SELECT p_brand, COUNT(*) AS lines, SUM(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    per_part = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return (per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand")
            .agg(F.sum("n").alias("lines"), F.sum("q").alias("quantity")))


@query("j2_left_join", """
    SELECT c_custkey, COUNT(o_orderkey) AS orders FROM customer
    LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def _(t):
    per_customer = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return (t.customer.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders")))


@query("j3_semi_join", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def _(t):
    rich = t.customer.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("j4_anti_join", """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("j7_full_outer_join", """
    SELECT COALESCE(s_nationkey, c_nationkey) AS nation, s.n AS suppliers, c.n AS customers
    FROM (SELECT s_nationkey, COUNT(*) AS n FROM supplier GROUP BY 1) s
    FULL JOIN (SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) c ON s_nationkey = c_nationkey""")
def _(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = t.customer.filter("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full_outer")


@query("j8_lookup_join", """
    SELECT c_custkey, n_name AS nation, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'industry' END AS sector
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    # A literal two-row map; the nation side is left to the size check of the planner.
    sectors = t.spark.createDataFrame([("BUILDING", "construction"), ("MACHINERY", "industry")], "c_mktsegment string, sector string")
    return (t.customer.join(F.broadcast(sectors), "c_mktsegment", "left")
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select("c_custkey", F.col("n_name").alias("nation"), "sector"))


@query("a1_sum_count_avg", """
    SELECT l_returnflag, l_linestatus, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total, COUNT(*) AS n,
           ROUND(AVG(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("total"), F.count("*").alias("n"),
        F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("a2_pair_counts", """
    SELECT l_suppkey AS source, l_partkey AS target, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def _(t):
    return (t.lineitem.groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "target").limit(20))


@query("a3_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("a4_count_distinct", """
    SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"),
                                                  F.count_distinct("l_suppkey").alias("suppliers"))


@query("a4_count_distinct_approximate", """
    SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS exact, TRUE AS near FROM lineitem GROUP BY 1""")
def _(t):
    # Within four standard errors of the exact number. In one aggregation there would be a sketch for each flag and part.
    parts = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.lit(None).cast("bigint").alias("exact"))
    exact = t.lineitem.groupBy("l_returnflag").agg(F.lit(None).cast("bigint").alias("parts"), F.count_distinct("l_partkey").alias("exact"))
    both = parts.unionByName(exact).groupBy("l_returnflag").agg(F.max("parts").alias("parts"), F.max("exact").alias("exact"))
    return both.select("l_returnflag", "exact", (F.abs(F.col("parts") - F.col("exact")) <= 0.08 * F.col("exact")).alias("near"))


def _grain_sql(grain):
    return f"""SELECT '{grain}' AS grain, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS period, l_returnflag AS flag, COUNT(*) AS "rows",
        CAST(SUM(CAST(l_quantity AS DECIMAL(38,6))) AS DOUBLE) AS quantity, COUNT(DISTINCT l_partkey) AS parts, TRUE AS near_parts, TRUE AS near_median
        FROM lineitem GROUP BY 1, 2, 3"""


@query("a4_grains_from_sketches", " UNION ALL ".join(map(_grain_sql, ("month", "year"))))
def _(t):
    # Counts, sums, distinct counts and medians by month and year from one stored row per day and flag.
    path = scratch_path(t.spark, "state")
    state = H.daily_state(t.lineitem, "l_shipdate", ["l_returnflag"], ["l_quantity"], ["l_partkey"], ["l_extendedprice"])
    H.add_load(state, path, "all")
    state = H.read_state(t.spark, path)
    parts = []
    for grain in ("month", "year"):
        rolled = H.roll_up(state, grain, ["l_returnflag"])
        # What the estimates are held against.
        own = t.lineitem.withColumn("period", F.date_trunc(grain, "l_shipdate").cast("date"))
        exact = own.groupBy("period", "l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"))
        below = own.join(rolled.select("period", "l_returnflag", F.col("percentiles_l_extendedprice")[0].alias("median")), ["period", "l_returnflag"])
        place = below.groupBy("period", "l_returnflag").agg(F.avg((F.col("l_extendedprice") < F.col("median")).cast("int")).alias("low"),
                                                            F.avg((F.col("l_extendedprice") <= F.col("median")).cast("int")).alias("high"))
        both = rolled.join(exact, ["period", "l_returnflag"]).join(place, ["period", "l_returnflag"])
        parts.append(both.select(
            F.lit(grain).alias("grain"), "period", F.col("l_returnflag").alias("flag"), "rows", F.col("sum_l_quantity").cast("double").alias("quantity"), "parts",
            (F.abs(F.col("distinct_l_partkey") - F.col("parts")) <= 0.06 * F.col("parts") + 1).alias("near_parts"),
            ((F.col("low") <= 0.54) & (F.col("high") >= 0.46)).alias("near_median")))
    return parts[0].unionByName(parts[1])


@query("a5_score_statistics", """
    SELECT CAST(ROUND(CAST(ROUND(AVG(value / 500), 9) AS DECIMAL(38,9)), 4) AS DOUBLE) AS mean, CAST(ROUND(CAST(ROUND(MIN(value / 500), 9) AS DECIMAL(38,9)), 4) AS DOUBLE) AS min, CAST(ROUND(CAST(ROUND(MAX(value / 500), 9) AS DECIMAL(38,9)), 4) AS DOUBLE) AS max, COUNT(*) AS count
    FROM events""")
def _(t):
    return K.score_stats(t.events.select((F.col("value") / 500).alias("confidence")))


@query("a5_score_statistics_empty", """
    SELECT COALESCE(AVG(value), 0.0) AS mean, COALESCE(MIN(value), 0.0) AS min, COALESCE(MAX(value), 0.0) AS max, COUNT(*) AS count
    FROM events WHERE value > 1000""")
def _(t):
    return K.score_stats(t.events.filter("value > 1000").select(F.col("value").alias("confidence")))


@query("a6_confidence_histogram", """
    SELECT LEAST(CAST(FLOOR(value / 500 * 10) AS BIGINT), 9) AS bucket, COUNT(*) AS n,
           CAST(COUNT_IF(CAST(props ->> '$.k' AS INT) > 20) AS BIGINT) AS grounded,
           CAST(COUNT_IF(CAST(props ->> '$.k' AS INT) <= 20) AS BIGINT) AS ungrounded FROM events GROUP BY 1""")
def _(t):
    scored = t.events.select((F.col("value") / 500).alias("confidence"),
                             (F.get_json_object("props", "$.k").cast("int") > 20).alias("grounded"))
    return K.confidence_histogram(scored, F.col("grounded"))


@query("a7_conditional_counts", """
    SELECT user_id, CAST(COUNT_IF(event_type = 'error') AS BIGINT) AS failed, CAST(COUNT_IF(event_type <> 'error') AS BIGINT) AS succeeded,
           CAST(COUNT_IF(event_type = 'purchase' AND value > 100) AS BIGINT) AS large FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") != "error").alias("succeeded"),
        F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("large"))


@query("a8_latency_percentiles", """
    SELECT event_type, ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.95), 6) AS p95,
           ROUND(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def _(t):
    df = K.latency_percentiles(t.events, "value", ["event_type"])
    return df.withColumns({p: F.round(p, 6) for p in ("p50", "p95", "p99")})


@query("a8_latency_percentiles_approximate", """
    SELECT event_type, COUNT(*) AS n, TRUE AS near FROM events GROUP BY 1""")
def _(t):
    # The rank of each approximate percentile is off by a thousandth of the rows and one row at most.
    about = K.latency_percentiles(t.events, "value", ["event_type"], accuracy=10000)
    near, v = F.lit(True), F.col("value")
    ranked = t.events.select("event_type", "value").join(about, "event_type").groupBy("event_type").agg(
        F.count("*").alias("n"), *[c for p in ("p50", "p95", "p99") for c in (
            F.count_if(v < F.col(p)).alias(f"{p}_below"), F.count_if(v <= F.col(p)).alias(f"{p}_upto"))])
    for name, share in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        near = near & (F.col(f"{name}_below") <= (share + 0.001) * F.col("n") + 1) & (F.col(f"{name}_upto") >= (share - 0.001) * F.col("n") - 1)
    return ranked.select("event_type", "n", near.alias("near"))


@query("w1_best_per_group", """
    SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn
        FROM lineitem) WHERE rn = 1""")
def _(t):
    rank = F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("l"))
    # An aggregate, not a window: a heavy group is reduced before the shuffle.
    best = t.lineitem.groupBy("l_suppkey").agg(F.max(rank).alias("b"))
    return best.select("l_suppkey", (-F.col("b.o")).alias("l_orderkey"), (-F.col("b.l")).alias("l_linenumber"), "b.l_extendedprice")


@query("w2_canonical_choice", """
    SELECT p_brand, p_name AS canonical FROM (SELECT p_brand, p_name, ROW_NUMBER() OVER (
        PARTITION BY p_brand ORDER BY CASE WHEN starts_with(p_name, 'red') THEN 0 ELSE 1 END, length(p_name), p_name) AS rn FROM part)
    WHERE rn = 1""")
def _(t):
    return K.canonical(t.part.select("p_brand", "p_name"), "p_brand", "p_name", prefix="red")


@query("w3_active_version", """
    SELECT o_custkey AS tenant, o_orderkey AS version, o_orderdate AS published_at,
           ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS active FROM orders""")
def _(t):
    versions = t.orders.select(F.col("o_custkey").alias("tenant"), F.col("o_orderkey").alias("version"),
                               F.col("o_orderdate").alias("published_at"))
    return K.mark_active(versions, "tenant", "published_at", "version")


@query("w4_index_in_document", """
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, lines[i] AS line FROM (
        SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))


@query("o1_multi_key_sort", """
    SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey LIMIT 100""")
def _(t):
    return (t.orders.orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(100)
            .select("o_orderkey", "o_totalprice", "o_orderdate"))


@query("o2_paging", """
    SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100""")
def _(t):
    return K.page(t.events.select("event_id", "ts", "event_type"), "ts", "event_id", limit=50, offset=100)


@query("o2_deep_page", """
    SELECT event_id, ts, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n, COUNT(*) OVER () AS total FROM events)
    WHERE n > total * 9 // 10 AND n <= total * 9 // 10 + 50""")
def _(t):
    # A page far down: found by counts per day, read from the days that hold it.
    rows = t.events.select("event_id", "ts", "event_type")
    index = materialise(K.page_index(rows, "ts"), "pages")
    total = index.agg(F.sum("rows")).first()[0]
    return K.seek_page(rows, index, "ts", "event_id", limit=50, offset=total * 9 // 10)


@query("u1_bag_union", """
    SELECT s_nationkey AS nation, 'supplier' AS kind, s_acctbal AS balance FROM supplier
    UNION ALL SELECT c_nationkey, 'customer', c_acctbal FROM customer""")
def _(t):
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    c = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))
    return s.unionByName(c)


@query("u2_set_difference", """
    SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def _(t):
    pairs = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey")
    return pairs("A").subtract(pairs("R"))


@query("u3_set_intersection", """
    SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def _(t):
    pairs = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey")
    return pairs("A").intersect(pairs("R"))


@query("u4_merge_sources", """
    SELECT CAST(user_id AS VARCHAR) AS s, event_type AS p, NULL AS score FROM events
    UNION ALL SELECT CAST(vec_id AS VARCHAR), NULL, ROUND(CAST(embedding[1] AS DOUBLE), 6) FROM embeddings""")
def _(t):
    graph = t.events.select(F.col("user_id").cast("string").alias("s"), F.col("event_type").alias("p"))
    vector = t.embeddings.select(F.col("vec_id").cast("string").alias("s"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    return graph.unionByName(vector, allowMissingColumns=True)
