"""Streaming: lineage to audit, request rates, duplicate suppression, file loads."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quadrille.operators.audit import lineage_to_audit, service_indicators

REQUESTS_PER_MINUTE = 60
WATERMARK = "10 minutes"


def lineage_stream(spark: SparkSession, source: str = "kafka", schema: str | None = None, path: str | None = None,
                   **options: str) -> DataFrame:
    """Raw lineage messages with a ``value`` column, from the earliest offset.

    ``kafka`` needs its connector on the class path; ``text`` and other file
    formats read a folder of landed messages.
    """
    if source == "kafka":
        options = {"startingOffsets": "earliest", **options}
    reader = spark.readStream.format(source).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def start_audit_sink(messages: DataFrame, path: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """Lineage messages to the append-only audit table; unreadable ones are left out.

    The file sink commits each batch once, so a restart neither loses nor
    repeats rows.
    """
    return (lineage_to_audit(messages).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).partitionBy("tenant_id")
            .trigger(**(trigger or {"availableNow": True})).start())


def request_counts(requests: DataFrame, time: str = "ts", tenant: str = "tenant_id", limit: int = REQUESTS_PER_MINUTE,
                   watermark: str = WATERMARK) -> DataFrame:
    """Requests per tenant and minute, the over-limit flag and what remains.

    A busy tenant is counted on the map side first; state is one row per tenant
    and open minute. A row that arrives later than the watermark allows is not
    counted any more: its minute is closed.
    """
    counted = (requests.withWatermark(time, watermark).groupBy(F.window(time, "1 minute").alias("window"), tenant)
               .agg(F.count("*").alias("requests")))
    return counted.select(F.col("window.start").alias("minute"), tenant, "requests", (F.col("requests") > limit).alias("over_limit"),
                          F.greatest(F.lit(limit) - F.col("requests"), F.lit(0)).alias("remaining"))


class _Minutes(StatefulProcessor):
    """Counts per minute of one tenant; what comes for a minute already closed is passed on as late."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", "us long")
        self.open = handle.getMapState("open", "minute long", "requests long")

    def handleInputRows(self, key, rows, timer_values):
        newest = self.newest.get()[0] if self.newest.exists() else None
        closed = None if newest is None else newest - self.delay
        taken: dict[int, int] = {}
        late: dict[int, int] = {}
        for frame in rows:
            for minute, n, last in zip(frame["minute"].tolist(), frame["n"].tolist(), frame["newest"].tolist(), strict=True):
                into = late if closed is not None and minute + MINUTE <= closed else taken
                into[minute] = into.get(minute, 0) + n
                newest = last if newest is None else max(newest, last)
        out = [("late", key[0], minute, n) for minute, n in sorted(late.items())]
        for minute, n in sorted(taken.items()):
            before = self.open.getValue((minute,))[0] if self.open.containsKey((minute,)) else 0
            self.open.updateValue((minute,), (before + n,))
            out.append(("count", key[0], minute, before + n))
        self.newest.update((newest,))
        for minute in [k[0] for k in self.open.keys()]:
            if minute + MINUTE <= newest - self.delay:
                self.open.removeKey((minute,))
        yield pd.DataFrame(out, columns=["kind", "tenant_id", "minute", "requests"])

    def close(self) -> None:
        pass


MINUTE = 60_000_000
LATE_SCHEMA = "kind string, tenant_id string, minute long, requests long"


def request_counts_with_late(requests: DataFrame, time: str = "ts", tenant: str = "tenant_id", delay_minutes: int = 10) -> DataFrame:
    """(kind, tenant_id, minute, requests): changed counts per minute (``count``), and how many rows came too late (``late``).

    As ``request_counts``, but nothing vanishes: a row whose minute ended more than ``delay_minutes`` before the
    newest row of its tenant, as of the batch before, is not dropped but counted in a row of its own. Of one minute the last
    ``count`` holds and the ``late`` rows add up; together they are all rows of the stream. Rows without a time
    belong to no minute and are left out. Rows are counted per minute where they are read, so a busy tenant is a few rows per
    batch; state is the open minutes of each tenant. Needs the RocksDB state store, which this sets for the session.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    us = F.unix_micros(F.col(time).cast("timestamp"))
    rows = requests.select(F.coalesce(F.col(tenant).cast("string"), F.lit("")).alias("tenant_id"), us.alias("_us"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            timed = batch[batch["_us"].notna()]
            minute = timed["_us"].astype("int64") // MINUTE * MINUTE
            groups = timed["_us"].astype("int64").groupby([timed["tenant_id"], minute.rename("minute")])
            yield groups.agg(["size", "max"]).reset_index().rename(columns={"size": "n", "max": "newest"})

    counted = rows.mapInPandas(partial, "tenant_id string, minute long, n long, newest long")
    return counted.groupBy("tenant_id").transformWithStateInPandas(
        _Minutes(delay_minutes * MINUTE), outputStructType=LATE_SCHEMA, outputMode="Update", timeMode="None")


def late_report(spark: SparkSession, path: str) -> DataFrame:
    """The counts and late rows of all batches that ``start_updates`` wrote under ``path``: (kind, tenant_id, minute, requests)."""
    rows = spark.read.schema(LATE_SCHEMA + ", batch int").option("basePath", path).parquet(path)
    return rows.groupBy("kind", "tenant_id", "minute").agg(
        F.when(F.col("kind") == "late", F.sum("requests")).otherwise(F.max_by("requests", "batch")).alias("requests")).withColumn(
        "minute", F.timestamp_micros("minute"))


def sliding_indicators(requests: DataFrame, time: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Five-minute rates refreshed every minute."""
    return service_indicators(requests.withWatermark(time, watermark), time, "5 minutes", "1 minute")


def suppress_duplicates(events: DataFrame, key: Sequence[str], time: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """First delivery of each event; later ones within the watermark are dropped, and rows beyond it altogether."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(key))


def start_file_load(spark: SparkSession, path: str, schema, target: str, checkpoint: str, file_format: str = "parquet",
                    files_per_batch: int = 1000) -> StreamingQuery:
    """Loads files that appeared since the last run, then stops; the checkpoint holds the state."""
    stream = (spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path))
    return (stream.writeStream.format("parquet").outputMode("append").option("path", target)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def start_updates(df: DataFrame, path: str, checkpoint: str, trigger: Mapping | None = None) -> StreamingQuery:
    """Changed rows of every batch, each batch in its own folder.

    A repeated batch overwrites its own folder, so the result is exact after a
    restart. ``latest_updates`` reads the current state.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (df.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def latest_updates(spark: SparkSession, path: str, schema, key: Sequence[str]) -> DataFrame:
    """The last written version of every key."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    full = StructType([*schema.fields, StructField("batch", IntegerType())])
    rows = spark.read.schema(full).option("basePath", path).parquet(path)
    values = [f.name for f in schema.fields if f.name not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*key, *[F.col(f"_v.{c}").alias(c) for c in values])
