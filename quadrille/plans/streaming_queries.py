"""Streaming queries (S14, T1-T5): the events table as a stream, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.plans.audit_queries import AUDIT_FROM_LINEAGE_SQL, INDICATOR_SQL, lineage_json, number
from quadrille.plans.registry import SCHEMAS, query
from quadrille.session import scratch_path
from quadrille.streaming import lineage as L


def _stream(t):
    """The events table as a file stream. The files are named with a pattern, as a stream reads a folder."""
    schema = T.StructType.fromDDL(SCHEMAS["events"])
    df = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events*.parquet")
    # A watermark needs a time with a zone.
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(t, df, key):
    path, checkpoint = scratch_path(t.spark, "updates"), scratch_path(t.spark, "state")
    L.start_updates(df, path, checkpoint).awaitTermination()
    return L.latest_updates(t.spark, path, df.schema, key)


def _plain(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("s14_lineage_source", "SELECT COUNT(*) AS messages, COUNT(*) FILTER (WHERE event_type = 'view') AS unreadable FROM events")
def _(t):
    landed, out, state = (scratch_path(t.spark, n) for n in ("messages", "raw", "state"))
    lineage_json(t).select("value").write.text(landed)
    messages = L.lineage_stream(t.spark, "text", path=landed)
    (messages.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
     .start().awaitTermination())
    stored = t.spark.read.schema("value string").parquet(out)
    return stored.agg(F.count("*").alias("messages"), F.count_if(F.col("value") == "{not json").alias("unreadable"))


@query("t1_lineage_to_audit_log", AUDIT_FROM_LINEAGE_SQL)
def _(t):
    landed, out, state = (scratch_path(t.spark, n) for n in ("messages", "audit", "state"))
    lineage_json(t).select("value").write.text(landed)
    messages = L.lineage_stream(t.spark, "text", path=landed)
    L.start_audit_sink(messages, out, state).awaitTermination()
    schema = "tenant_id string, action string, status string, context string, query_hash string, created_at timestamp"
    return _plain(t.spark.read.schema(schema).parquet(out), "created_at")


@query("t2_request_counts_per_minute", """
    SELECT date_trunc('minute', ts) AS minute, 't' || (user_id % 3) AS tenant_id, COUNT(*) AS requests, COUNT(*) > 2 AS over_limit,
           GREATEST(2 - COUNT(*), 0) AS remaining FROM events GROUP BY 1, 2""")
def _(t):
    requests = _stream(t).withColumn("tenant_id", F.concat(F.lit("t"), F.col("user_id") % 3))
    return _plain(_run(t, L.request_counts(requests, limit=2), ["minute", "tenant_id"]), "minute")


def _in_batches(t, repeated: bool):
    """The events as a stream of one batch per four days; the last five minutes of each come with the next, too or instead."""
    landed = scratch_path(t.spark, "landing")
    four_days = 4 * 86_400
    second = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)
    late = second % four_days >= four_days - 300
    part = F.floor(second / four_days)
    rows = t.events.withColumn("part", part)
    moved = rows.filter(late).withColumn("part", F.col("part") + 1)
    rows = (rows if repeated else rows.filter(~late)).unionByName(moved)
    first, last = rows.agg(F.min("part"), F.max("part")).first()
    for p in range(first, last + 1):
        rows.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(landed)
    schema = T.StructType.fromDDL(SCHEMAS["events"])
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed).withColumn("ts", F.col("ts").cast("timestamp"))


@query("t2_request_counts_in_batches", """
    SELECT date_trunc('minute', ts) AS minute, 't' || (user_id % 3) AS tenant_id, COUNT(*) AS requests, COUNT(*) > 2 AS over_limit,
           GREATEST(2 - COUNT(*), 0) AS remaining FROM events GROUP BY 1, 2""")
def _(t):
    # Many batches, rows out of order within the watermark.
    requests = _in_batches(t, repeated=False).withColumn("tenant_id", F.concat(F.lit("t"), F.col("user_id") % 3))
    return _plain(_run(t, L.request_counts(requests, limit=2), ["minute", "tenant_id"]), "minute")


@query("t2_late_requests", """
    WITH e AS (SELECT ts, date_trunc('minute', ts) AS minute, 't' || (user_id % 3) AS tenant_id,
        CAST(floor(epoch_us(ts) / 1000000 / 345600) AS BIGINT) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS part FROM events),
    seen AS (SELECT tenant_id, part, MAX(MAX(ts)) OVER (PARTITION BY tenant_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
        FROM e GROUP BY tenant_id, part)
    SELECT CASE WHEN minute + INTERVAL 1 MINUTE <= newest - INTERVAL 10 MINUTE THEN 'late' ELSE 'count' END AS kind, tenant_id, minute, COUNT(*) AS requests
    FROM e JOIN seen USING (tenant_id, part) GROUP BY 1, 2, 3""")
def _(t):
    # A batch per four days; every seventh event comes with the batch after its own.
    landed, path, state = (scratch_path(t.spark, n) for n in ("landing", "updates", "state"))
    part = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000) / (4 * 86_400))
    rows = t.events.withColumn("part", part + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    first, last = rows.agg(F.min("part"), F.max("part")).first()
    for p in range(first, last + 1):
        rows.filter(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(landed)
    stream = t.spark.readStream.schema(T.StructType.fromDDL(SCHEMAS["events"])).option("maxFilesPerTrigger", 1).parquet(landed)
    requests = stream.withColumn("tenant_id", F.concat(F.lit("t"), F.col("user_id") % 3))
    L.start_updates(L.request_counts_with_late(requests), path, state).awaitTermination()
    return _plain(L.late_report(t.spark, path), "minute")


@query("t4_duplicates_across_batches", "SELECT event_id, event_type FROM events")
def _(t):
    out, state = scratch_path(t.spark, "once"), scratch_path(t.spark, "state")
    once = L.suppress_duplicates(_in_batches(t, repeated=True), ["event_id"]).select("event_id", "event_type")
    (once.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
     .start().awaitTermination())
    return t.spark.read.schema(once.schema).parquet(out)


@query("t3_sliding_rates", INDICATOR_SQL.format(
    seconds=300, source="(SELECT *, unnest([date_trunc('minute', ts) - to_minutes(i) FOR i IN range(0, 5)]) AS window_start FROM events)"))
def _(t):
    e = F.col("event_type")
    flags = _stream(t).select("ts", (e == "error").alias("is_error"), (e == "click").alias("is_hit"), (e == "view").alias("is_miss"),
                              F.when(e == "purchase", number()).otherwise(0).alias("ingested"))
    return _plain(_run(t, L.sliding_indicators(flags), ["window_start"]), "window_start")


@query("t4_duplicate_suppression", "SELECT event_id, event_type FROM events")
def _(t):
    # Every event is delivered twice.
    twice = _stream(t).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    out, state = scratch_path(t.spark, "once"), scratch_path(t.spark, "state")
    once = L.suppress_duplicates(twice, ["event_id"]).select("event_id", "event_type")
    (once.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
     .start().awaitTermination())
    return t.spark.read.schema(once.schema).parquet(out)


@query("t5_incremental_file_load", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    landed, out, state = (scratch_path(t.spark, n) for n in ("landing", "loaded", "state"))
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    # Two deliveries and two runs: the second run takes only the new files.
    for part in (rows.filter("o_orderstatus = 'F'"), rows.filter("o_orderstatus <> 'F'")):
        part.write.mode("append").parquet(landed)
        L.start_file_load(t.spark, landed, rows.schema, out, state).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out)
