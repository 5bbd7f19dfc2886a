"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Arrow batches towards Python end at this many bytes, so that a run of very
# long texts cannot fill a worker.
BATCH_BYTES = 16 << 20
# Broadcast objects that a worker keeps.
KEPT = 4


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Cut the session's Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def per_process(make: Callable) -> Callable:
    """Remember what ``make`` gives for its arguments as long as the process lives.

    The results hang on the interpreter's own table of modules: functions of this package travel by
    value, each time with globals of their own, to workers that cannot import it.
    """
    name = f"{make.__module__}.{make.__qualname__}"

    def get(*args):
        import sys
        import types

        kept = vars(sys.modules.setdefault("_kept_by_text_operators", types.ModuleType("_kept_by_text_operators")))
        key = (name, *args)
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return get


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast an object of this package's own classes; the function returned gives it, in tasks too.

    It travels as bytes that hold its classes, and a worker keeps the last few it has read.
    """
    return shared_bytes(spark.sparkContext.broadcast(cloudpickle.dumps(value)))


def shared_bytes(sent: Broadcast) -> Callable[[], object]:
    """The same for an object that is in a broadcast as bytes."""
    name = uuid.uuid4().hex

    def get():
        import sys
        import types

        kept = vars(sys.modules.setdefault("_kept_by_text_operators", types.ModuleType("_kept_by_text_operators"))).setdefault("shared", {})
        if name not in kept:
            while len(kept) >= KEPT:
                kept.pop(next(iter(kept)))
            kept[name] = cloudpickle.loads(sent.value)
        return kept[name]

    return get


def plain(text: str | Column) -> Column:
    """A text column with empty strings for nulls."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def with_row(df: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``row`` (the columns of ``df`` as one struct) beside ``text`` (null: empty).

    Results are put beside ``row``, so that no column of the input can clash
    with one of them. ``drop_text`` leaves the text out of ``row``.
    """
    kept = [c for c in df.columns if not (drop_text and c == text)]
    return df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), plain(text).alias("text"))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list], dict[str, list]]], added: str, text: str = "text") -> DataFrame:
    """Apply a function of a list of texts in each task; its columns replace ``text``.

    ``make`` runs once per task and returns the function, which gives one list
    per column of ``added`` (a DDL string), as long as its input.
    """
    new = StructType.fromDDL(added)
    schema = StructType([f for f in df.schema if f.name != text] + new.fields)
    kinds = {f.name: to_arrow_type(f.dataType) for f in new}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            kept = [i for i, n in enumerate(batch.schema.names) if n != text]
            out = of(batch.column(batch.schema.get_field_index(text)).to_pylist())
            arrays = [batch.column(i) for i in kept] + [pa.array(out[n], k) for n, k in kinds.items()]
            fields = [batch.schema.field(i) for i in kept] + [pa.field(n, k) for n, k in kinds.items()]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return df.mapInArrow(run, schema)
