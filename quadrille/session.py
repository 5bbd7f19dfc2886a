"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

# Settings the plans in this package were tuned with. They are set where a
# session is created; an existing session keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_own_roots: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "quadrille", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    partitions = str(cores) if str(cores).isdigit() else "8"
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": partitions, "spark.driver.memory": "20g", **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a fresh temporary
    folder. On a cluster a machine-local folder would be lost with its machine,
    so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        _own_roots[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used instead of ``checkpoint()``, which evaluates the plan twice when it is
    eager. The result has no lineage, survives the loss of any executor, and
    later reads of it prune columns and push filters down.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows that one task sorts or hashes at once; a quad takes some 350 bytes there.
ROWS_PER_TASK = 500_000
# Rows that one task makes quads of where a table is dealt out first.
ROWS_TO_QUADS = 50_000


def deal(df: DataFrame, *keys: str | Column, rows: int | None = None, total: int | None = None) -> DataFrame:
    """Rows dealt out by ``keys`` to as many tasks as their number asks for.

    Splits of compressed files and the partitions that adaptive execution coalesces
    hold more rows the larger a table is; these do not. ``total`` saves counting; a bound from above will do.
    """
    total = df.count() if total is None else total
    return df.repartition(max(-(-total // (rows or ROWS_PER_TASK)), df.sparkSession.sparkContext.defaultParallelism), *keys)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Round-robin rows before Python-heavy work on few, large input splits.

    A small file is one split however many cores wait for it. The shuffle is
    only added when the scan has fewer partitions than the cluster has slots.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots)
