"""Stored aggregates that merge: counts, sums, distinct counts and percentiles at any grain from one scan.

``daily_state`` makes one row per day and combination of dimensions: rows, sums,
least and greatest values, an HLL sketch for each column to be counted distinct and a KLL sketch for each
column to be ranked. The rows of many loads lie side by side (``add_load``); ``roll_up``
merges them to a coarser grain and fewer dimensions. The table is never scanned again, and two loads, or two
sources, add up, which exact distinct counts do not.

The relative standard error of a distinct count is about 0.83 / sqrt(2 ** lg), that of a
percentile's rank about 1.7 / k percent of 100 (below 1.7 % for the default of 200).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 12, 200
GRAINS = ("day", "week", "month", "quarter", "year")


def _exact(col: Column) -> Column:
    """Sums of decimals do not depend on the order of addition."""
    return F.sum(col.cast("decimal(38,6)"))


def daily_state(df: DataFrame, time: str, dimensions: Sequence[str] = (), sums: Sequence[str] = (), distinct: Sequence[str] = (),
                ranked: Sequence[str] = (), lg: int = LG, k: int = K) -> DataFrame:
    """(day, dimensions, rows, sum_…, low_…, high_…, hll_…, kll_…); rows without a time have a null day.

    Sketches are built on the map side, so a day or a dimension with a third of all
    rows is one sketch per task before the shuffle.
    """
    measures = [F.count(F.lit(1)).alias("rows")]
    for c in sums:
        measures += [_exact(F.col(c)).alias(f"sum_{c}"), F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}")]
    measures += [F.hll_sketch_agg(F.col(c).cast("string"), lg).alias(f"hll_{c}") for c in distinct]
    measures += [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(f"kll_{c}") for c in ranked]
    return df.groupBy(F.to_date(time).alias("day"), *dimensions).agg(*measures)


def add_load(state: DataFrame, path: str, load: str) -> None:
    """Store the state of one load; a repeated load replaces itself."""
    state.write.mode("overwrite").parquet(f"{path}/load={load}")


def read_state(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("load")


def roll_up(state: DataFrame, grain: str | None = None, dimensions: Sequence[str] = (), percentiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(period, dimensions, rows, sum_…, low_…, high_…, distinct_…, percentiles_…) from stored rows.

    ``grain`` is one of GRAINS; without it all days are one period, which has no column. What has no values has null
    percentiles and counts zero.
    """
    if grain is not None and grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    period = [] if grain is None else [F.date_trunc(grain, "day").cast("date").alias("period")]
    of = lambda prefix: [c for c in state.columns if c.startswith(prefix)]
    merged = state.groupBy(*period, *dimensions).agg(
        F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in of("sum_")], *[F.min(c).alias(c) for c in of("low_")],
        *[F.max(c).alias(c) for c in of("high_")], *[F.hll_union_agg(c).alias(c) for c in of("hll_")],
        *[F.kll_merge_agg_double(c).alias(c) for c in of("kll_")])
    points = F.array(*[F.lit(float(p)) for p in percentiles])
    return merged.select(
        *(["period"] if grain else []), *dimensions, "rows", *of("sum_"), *of("low_"), *of("high_"),
        *[F.hll_sketch_estimate(c).alias(f"distinct_{c[4:]}") for c in of("hll_")],
        *[F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, points)).alias(f"percentiles_{c[4:]}") for c in of("kll_")])
