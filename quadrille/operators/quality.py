"""Scores, gates, choices and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAPPING_THRESHOLD = 0.75


def settled(mean: Column, places: int) -> Column:
    """A mean of doubles rounded half up, the same whatever the order of its partial sums.

    Sums differ in the last bits by the order of addition; rounded to 9 places
    first, as a decimal, ties come out alike.
    """
    return F.round(F.round(mean.cast("double"), 9).cast("decimal(38,9)"), places).cast("double")


def score_stats(df: DataFrame, column: str = "confidence") -> DataFrame:
    """Mean, min and max rounded to 4 places, and the count; zeros for no rows."""
    c = F.col(column)
    value = lambda a: F.coalesce(settled(a, 4), F.lit(0.0))
    return df.agg(value(F.avg(c)).alias("mean"), value(F.min(c)).alias("min"), value(F.max(c)).alias("max"),
                  F.count(c).alias("count"))


def confidence_histogram(df: DataFrame, grounded: Column, column: str = "confidence") -> DataFrame:
    """Counts per tenth; 1.0 belongs to the last bucket."""
    bucket = F.least(F.floor(F.col(column) * 10), F.lit(9).cast("bigint"))
    return df.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(grounded).alias("grounded"), F.count_if(~grounded).alias("ungrounded"))


def latency_percentiles(df: DataFrame, column: str, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """p50, p95 and p99; exact, or with bounded memory when ``accuracy`` is given."""
    points = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    p = F.percentile(column, points) if accuracy is None else F.percentile_approx(column, points, accuracy)
    return df.groupBy(*by).agg(p.alias("_p")).select(
        *by, *[F.col("_p")[i].alias(name) for i, name in enumerate(("p50", "p95", "p99"))])


def accept_mappings(df: DataFrame, threshold: float = MAPPING_THRESHOLD) -> DataFrame:
    """Flags mappings as accepted (confidence at or above the threshold) or not."""
    return df.withColumn("accepted", F.coalesce(F.col("confidence") >= threshold, F.lit(False)))


def canonical(df: DataFrame, group: str, iri: str, prefix: str) -> DataFrame:
    """One value per group: with the preferred prefix, then shortest, then first."""
    rank = F.struct((~F.col(iri).startswith(prefix)).alias("other"), F.length(iri).alias("len"), F.col(iri).alias("iri"))
    return df.groupBy(group).agg(F.min(rank).alias("_r")).select(group, F.col("_r.iri").alias("canonical"))


def mark_active(df: DataFrame, tenant: str, published: str, version: str) -> DataFrame:
    """``active`` on the latest published version of each tenant.

    The latest version is an aggregate joined back, so a tenant with very many
    versions is not sorted in one task.
    """
    newest = df.groupBy(tenant).agg(F.max(F.struct(published, version)).alias("_newest"))
    return (df.join(newest, tenant)
            .withColumn("active", F.struct(published, version) == F.col("_newest")).drop("_newest"))


def page(df: DataFrame, time: str, tie: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first, ``offset`` rows skipped, at most ``limit`` (no more than 500) returned."""
    if not 0 < limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return df.orderBy(F.desc(time), F.desc(tie)).offset(offset).limit(limit)


def page_index(df: DataFrame, time: str, grain: str = "day") -> DataFrame:
    """(start, rows, before): how many rows each range of the time has and how many newer ones there are.

    As many rows as ranges; write it beside the table. Rows without a time are the last range.
    """
    counts = df.groupBy(F.date_trunc(grain, time).cast(df.schema[time].dataType).alias("start")).agg(F.count(F.lit(1)).alias("rows"))
    newest = Window.orderBy(F.desc_nulls_last("start"))
    return counts.withColumn("before", F.sum("rows").over(newest) - F.col("rows"))


def seek_page(df: DataFrame, index: DataFrame, time: str, tie: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page that ``page`` returns, from the one or few ranges of ``index`` that hold it.

    The rows before them are neither read nor sorted: the bounds are conditions on the time column, which reach the scan.
    """
    if not 0 < limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    held = index.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset))
    # One row: the bounds and how many rows of the first range to pass over.
    low, high, nulls, before = held.agg(F.min("start"), F.max("start"), F.count_if(F.col("start").isNull()) > 0, F.min("before")).first()
    if before is None:
        return df.limit(0)
    kind = df.schema[time].dataType
    # The range after the newest one bounds it from above.
    above = index.filter(F.col("start") > F.lit(high).cast(kind)).agg(F.min("start")).first()[0] if high is not None else None
    inside = F.lit(False)
    if low is not None:
        inside = F.col(time) >= F.lit(low).cast(kind)
        if above is not None:
            inside = inside & (F.col(time) < F.lit(above).cast(kind))
    if nulls:
        inside = inside | F.col(time).isNull()
    return df.filter(inside).orderBy(F.desc_nulls_last(time), F.desc(tie)).offset(offset - before).limit(limit)
