"""Projections, mapping and predicates as Column expressions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quadrille import vocab

# Declared property types and the Spark types they are read as.
SPARK_TYPES = {
    "string": "string",
    "integer": "bigint",
    "date": "date",
    "datetime": "timestamp",
    "boolean": "boolean",
    "anyURI": "string",
    "float": "double",
}

# Text read as a plain "decimal" keeps this much; declare "decimal(p,s)" for more.
TEXT_DECIMAL = "decimal(38,18)"


def spark_type(declared: str) -> str:
    """The Spark type of a declared one; ``decimal(p,s)`` stands for itself."""
    if declared == "decimal":
        return TEXT_DECIMAL
    return declared if declared.startswith("decimal(") else SPARK_TYPES[declared]


def plain_number(col: Column) -> Column:
    """A number, or the text of one, in full: every digit it has, no exponent."""
    text = F.upper(F.trim(col.cast("string")))
    # Sign, digits before and after the point, exponent.
    part = F.split(F.regexp_replace(text, r"^([+-]?)([0-9]*)\.?([0-9]*)E([+-]?[0-9]+)$", "$1,$2,$3,$4"), ",")
    digits, at = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(2))), F.length(F.get(part, F.lit(1))) + F.get(part, F.lit(3)).try_cast("int")
    # With a zero where none is before or behind the point once it has moved. Little code: it is part of every cell.
    full = F.concat(F.repeat(F.lit("0"), 1 - at), digits, F.repeat(F.lit("0"), at - F.length(digits) + 1))
    moved = F.overlay(full, F.lit("."), F.greatest(at, F.lit(1)) + 1, F.lit(0))
    return F.when(text.contains("E"), F.concat(F.replace(F.get(part, F.lit(0)), F.lit("+"), F.lit("")), moved)).otherwise(col.cast("string"))


def iso_time(col: Column) -> Column:
    """A time as ``yyyy-MM-ddTHH:mm:ss``, with as much of a second's fraction as there is."""
    return F.replace(col.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))

COMPARISONS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class ColumnMap:
    """One target column: where it comes from and how it is converted."""

    source: str
    target: str
    type: str = "string"
    values: Mapping[str, object] | None = None
    annotation: str | None = None


def quoted(name: str) -> Column:
    """A column by exact name, also when the name contains dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_columns(df: DataFrame, mapping: Sequence[ColumnMap], annotate: bool = True) -> DataFrame:
    """Rename, convert and annotate columns in a single projection."""
    columns = []
    for m in mapping:
        source = quoted(m.source)
        if m.values is not None:
            value = value_map(source, m.values)
        elif m.type == "boolean":
            value = flag(source)
        elif m.type in ("string", "anyURI"):
            value = source.cast("string")
        else:
            kind = df.schema[m.source].dataType
            # Numbers keep the type they have, unless a precision is declared.
            value = source if m.type == "decimal" and isinstance(kind, NumericType) else source.try_cast(spark_type(m.type))
        columns.append(value.alias(m.target))
    if annotate:
        columns += [F.lit(m.annotation).alias(f"_class_{m.target}") for m in mapping if m.annotation]
    return df.select(*columns)


def lenient(col: Column, type_name: str = "double") -> Column:
    """Cast, with null instead of an error where the text does not parse."""
    return col.try_cast(type_name)


def value_map(col: Column, values: Mapping[str, object]) -> Column:
    """Recode categories; values outside the map become null."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.element_at(table, col.cast("string"))


def step_to_timestamp(step: Column, start: str, unit: str = "hours") -> Column:
    """Simulation step number to a point in time, counted from ``start``."""
    if unit not in ("days", "hours", "mins", "secs"):
        raise ValueError(f"unknown unit: {unit}")
    return F.lit(start).cast("timestamp_ntz") + F.make_interval(**{unit: step.cast("int")})


_PLACEHOLDER = re.compile(r"\{([^{}]+)\}")


def template(pattern: str) -> Column:
    """``prefix-{column}`` as a Column; null as soon as a part is null."""
    parts, at = [], 0
    for found in _PLACEHOLDER.finditer(pattern):
        if found.start() > at:
            parts.append(F.lit(pattern[at : found.start()]))
        parts.append(quoted(found.group(1)).cast("string"))
        at = found.end()
    if at < len(pattern):
        parts.append(F.lit(pattern[at:]))
    return F.concat(*parts)


def subject_template(base: str, table: str, keys: Sequence[str]) -> Column:
    """Row identifier from the primary key, or from a row number without one."""
    if keys:
        return template(f"{base}{table}/" + "/".join("{" + k + "}" for k in keys))
    return F.concat(F.lit(f"{base}{table}/"), F.monotonically_increasing_id().cast("string"))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5, computed without leaving the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def row_ids(df: DataFrame, order: Sequence[str], time_column: str, prefix: str = "aml") -> DataFrame:
    """Deterministic ``transaction_id`` from row index and time.

    A scan has no file order, so the index is taken from ``order``, which must
    be a total order. Rows are numbered per range partition and shifted by the
    partition's offset: no step sees the whole table in one task.
    """
    # The same range partitioning must serve the counts and the rows, so it is
    # written once.
    from quadrille.session import materialise

    ranged = materialise(
        df.repartitionByRange(*[F.col(c) for c in order])
        .withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").count()
    # One row per partition of the job: its size is the partition count.
    offsets = counts.select(
        "_part",
        (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order)
    index = F.row_number().over(within) - 1 + F.col("_offset")
    name = F.concat(F.lit(f"{prefix}-"), index.cast("string"), F.lit("-"),
                    F.coalesce(F.col(time_column).cast("string"), F.lit("")))
    return (ranged.join(F.broadcast(offsets), "_part")
            .withColumn("transaction_id", uuid5(name)).drop("_part", "_offset"))


def typed_literal(value: object) -> Column:
    if isinstance(value, (str, bool, int, float, date, datetime, Decimal)):
        return F.lit(value)
    raise TypeError(f"a filter value cannot be a {type(value).__name__}")


def filter_condition(filters: Mapping[str, object]) -> Column | None:
    """Equality, IN and IS NULL conditions from a dict, AND-ed."""
    conditions = []
    for name, value in filters.items():
        col = quoted(name)
        if value is None:
            conditions.append(col.isNull())
        elif isinstance(value, (list, tuple, set, frozenset)):
            conditions.append(col.isin([typed_literal(v) for v in value]))
        else:
            conditions.append(col == typed_literal(value))
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def apply_filters(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    condition = filter_condition(filters or {})
    return df if condition is None else df.filter(condition)


def operator_condition(clause: Mapping[str, object]) -> Column:
    """One ``{field, operator, value}`` clause with a typed literal."""
    col, operator, value = quoted(str(clause["field"])), str(clause.get("operator", "=")).upper(), clause["value"]
    if operator == "IN":
        return col.isin([typed_literal(v) for v in value])
    if operator not in COMPARISONS:
        raise ValueError(f"unknown operator: {operator}")
    return COMPARISONS[operator](col, typed_literal(value))


def operator_filters(df: DataFrame, clauses: Iterable[Mapping[str, object]]) -> DataFrame:
    for clause in clauses:
        df = df.filter(operator_condition(clause))
    return df


def time_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive; an end date means its midnight.

    The bounds are cast to the column's own type, never the column, so that
    the comparison reaches the file scan.
    """
    kind = dict(df.dtypes)[column]
    if start is not None:
        df = df.filter(quoted(column) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.filter(quoted(column) <= F.lit(end).cast(kind))
    return df


def sql_filter(df: DataFrame, *predicates: str | None) -> DataFrame:
    """AND-ed SQL predicates; empty ones are skipped."""
    for predicate in predicates:
        if predicate and predicate.strip():
            df = df.filter(F.expr(predicate))
    return df


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with null for a zero denominator (ANSI mode would raise)."""
    return numerator / F.nullif(denominator, F.lit(0))


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(F.coalesce(end, F.current_timestamp()), start)


def hours_between(end: Column, start: Column) -> Column:
    """Elapsed hours; an open end counts up to now."""
    seconds = F.unix_timestamp(F.coalesce(end.cast("timestamp"), F.current_timestamp())) - F.unix_timestamp(
        start.cast("timestamp"))
    return seconds / F.lit(3600)


def expand_curie(col: Column, prefixes: Mapping[str, str] = vocab.PREFIXES) -> Column:
    """``prefix:name`` to an IRI; unknown prefixes and full IRIs stay as they are."""
    space = F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(prefixes.items())]),
                         F.substring_index(col, ":", 1))
    return F.when(space.isNotNull() & col.contains(":"),
                  F.concat(space, F.substr(col, F.instr(col, ":") + 1))).otherwise(col)


def compact_iri(col: Column, prefixes: Mapping[str, str] = vocab.PREFIXES) -> Column:
    """IRI to ``prefix:name`` by the longest matching namespace."""
    result = col
    # Shorter namespaces are tested last, so build the chain from the shortest.
    for prefix, space in sorted(prefixes.items(), key=lambda kv: len(kv[1])):
        short = F.concat(F.lit(prefix + ":"), F.substr(col, F.lit(len(space) + 1)))
        result = F.when(col.startswith(space), short).otherwise(result)
    return result


def local_name(col: Column) -> Column:
    """Part after the last ``/``, then after the last ``#``."""
    return F.substring_index(F.substring_index(col, "/", -1), "#", -1)


def short_class(col: Column) -> Column:
    """Part after the last ``:``, then after the last ``/``."""
    return F.substring_index(F.substring_index(col, ":", -1), "/", -1)


def term_kind(col: Column, schemes: Sequence[str] = ("http://", "https://", f"{vocab.SCHEME}://")) -> Column:
    """``iri`` for values that start with a known scheme, else ``literal``."""
    return F.when(reduce(lambda a, b: a | b, [col.startswith(s) for s in schemes]), "iri").otherwise("literal")


def flag(col: Column) -> Column:
    """Truth of a 0/1 or true/false marker of any type; null is false."""
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin("1", "true"), F.lit(False))


def query_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
