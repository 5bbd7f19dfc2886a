"""Metrics declared once, evaluated as one lazy plan.

Shape of every plan: filters on the fact, a partial aggregate on the join keys,
left joins along the reference path, then the final aggregate. The partial
aggregate comes first because a popular key (a third of the fact on one
counterparty) is then collapsed on the map side and reaches the join as one row
per key instead of millions.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.columns import (
    filter_condition, operator_condition, quoted, spark_type, sql_filter, time_range)

AGGREGATES = ("sum", "count", "avg", "min", "max", "count_distinct", "approx_count_distinct", "latest", "custom")
GRAINS = ("day", "week", "month", "quarter", "year")
_SNAKE = re.compile(r"^[a-z][a-z0-9_]{0,79}$")


class ContextAmbiguousError(ValueError):
    """The metric has several contexts and none was named."""

    def __init__(self, metric: str, contexts: Sequence[str]):
        super().__init__(f"metric {metric!r} is defined in contexts {list(contexts)}; name one")
        self.contexts = list(contexts)


class ContextNotFoundError(KeyError):
    """The named context does not exist for the metric."""


class JoinPathError(ValueError):
    """No reference path to the dimension's entity, or more than one shortest."""


@dataclass(frozen=True)
class PropertySpec:
    """A named column of an entity; ``contexts`` may swap in another SQL expression."""

    name: str
    column: str | None = None
    type: str = "string"
    nullable: bool = True
    allowed: tuple[str, ...] = ()
    pattern: str | None = None
    contexts: Mapping[str, str] = field(default_factory=dict)
    references: tuple[str, str] | None = None

    def expression(self, context: str | None) -> str:
        if context in self.contexts:
            return self.contexts[context]
        if self.column is None:
            raise ContextAmbiguousError(self.name, sorted(self.contexts))
        return self.column


@dataclass(frozen=True)
class EntitySpec:
    name: str
    table: str
    properties: tuple[PropertySpec, ...]
    alias: str | None = None
    contexts: Mapping[str, str] = field(default_factory=dict)

    def property(self, name: str) -> PropertySpec:
        for p in self.properties:
            if p.name == name:
                return p
        raise KeyError(f"{self.name} has no property {name!r}")

    def has(self, name: str) -> bool:
        return any(p.name == name for p in self.properties)

    def references(self) -> list[tuple[PropertySpec, str, str]]:
        return [(p, *p.references) for p in self.properties if p.references]


@dataclass(frozen=True)
class Dimension:
    """``via`` names the reference properties to follow where the path is not unique."""

    name: str
    entity: str
    property: str
    via: tuple[str, ...] | None = None


@dataclass(frozen=True)
class MetricContext:
    filter: str | None = None
    filters: tuple[Mapping[str, object], ...] = ()
    extra_dimensions: tuple[str, ...] = ()


@dataclass(frozen=True)
class MetricSpec:
    name: str
    type: str
    entity: str
    measure: str | None = None
    measure_sql: str | None = None
    dimensions: tuple[Dimension, ...] = ()
    contexts: Mapping[str, MetricContext] = field(default_factory=dict)
    default_filter: str | None = None
    time_grains: tuple[str, ...] = ()
    time_column: str | None = None

    def __post_init__(self) -> None:
        if not _SNAKE.match(self.name):
            raise ValueError(f"metric name must be snake_case: {self.name!r}")
        if self.type not in AGGREGATES:
            raise ValueError(f"type must be one of {AGGREGATES}, got {self.type!r}")
        if set(self.time_grains) - set(GRAINS):
            raise ValueError(f"time grains must be among {GRAINS}")
        if self.time_grains and not self.time_column:
            raise ValueError(f"{self.name}: time_column is needed with time_grains")
        if self.type == "custom" and not self.measure_sql:
            raise ValueError(f"{self.name}: a custom metric needs measure_sql")
        if self.type == "latest" and not self.time_column:
            raise ValueError(f"{self.name}: a latest metric needs time_column")

    def dimension(self, name: str) -> Dimension:
        for d in self.dimensions:
            if d.name == name:
                return d
        if "." in name:
            entity, prop = name.split(".", 1)
            return Dimension(name.replace(".", "_"), entity, prop)
        return Dimension(name, self.entity, name)


@dataclass(frozen=True)
class Model:
    entities: Mapping[str, EntitySpec]

    @staticmethod
    def of(*entities: EntitySpec) -> "Model":
        return Model({e.name: e for e in entities})


def resolve_context(spec: MetricSpec, context: str | None) -> str | None:
    """The named context, or the only one; several without a name is an error."""
    if context is not None:
        if spec.contexts and context not in spec.contexts:
            raise ContextNotFoundError(context)
        return context
    if len(spec.contexts) > 1:
        raise ContextAmbiguousError(spec.name, sorted(spec.contexts))
    return next(iter(spec.contexts), None)


def join_path(model: Model, start: str, goal: str, via: Sequence[str] | None = None
              ) -> tuple[tuple[str, PropertySpec, str, str], ...]:
    """Hops ``(from, property, to, key)`` along references, breadth first."""
    if via is not None:
        hops, at = [], start
        for name in via:
            prop = model.entities[at].property(name)
            if not prop.references:
                raise JoinPathError(f"{at}.{name} is not a reference")
            hops.append((at, prop, *prop.references))
            at = prop.references[0]
        if at != goal:
            raise JoinPathError(f"path {tuple(via)} ends at {at}, not {goal}")
        return tuple(hops)
    queue = deque([((), start)])
    found: list[tuple] = []
    while queue:
        path, at = queue.popleft()
        if found and len(path) >= len(found[0]):
            break
        for prop, entity, key in model.entities[at].references():
            if entity == start or any(h[2] == entity for h in path):
                continue
            longer = path + ((at, prop, entity, key),)
            if entity == goal:
                found.append(longer)
            else:
                queue.append((longer, entity))
    shortest = [p for p in found if len(p) == len(found[0])]
    if not shortest:
        raise JoinPathError(f"no reference path from {start} to {goal}")
    if len(shortest) > 1:
        raise JoinPathError(f"several shortest paths from {start} to {goal}; name one with via")
    return shortest[0]


def property_column(entity: EntitySpec, name: str, context: str | None) -> Column:
    prop = entity.property(name)
    col = F.expr(prop.expression(context))
    # A plain decimal is what the column is; a precision has to be declared.
    return col if prop.type in ("string", "anyURI", "decimal") else col.cast(spark_type(prop.type))


def _aggregate(kind: str, value: Column | None, time: Column | None, sql: str | None) -> Column:
    match kind:
        case "sum":
            return F.sum(value)
        case "count":
            return F.count(F.lit(1) if value is None else value)
        case "avg":
            return F.avg(value)
        case "min":
            return F.min(value)
        case "max":
            return F.max(value)
        case "count_distinct":
            return F.count_distinct(value)
        case "approx_count_distinct":
            return F.approx_count_distinct(value)
        case "latest":
            return F.max_by(value, time)
    return F.expr(sql)


def _partial(kind: str) -> tuple[list[Column], Column] | None:
    """Partial columns before the join and the expression that merges them."""
    v, n = F.col("_value"), F.col("_n")
    match kind:
        case "sum":
            return [F.sum(v).alias("_value")], F.sum(v)
        case "count":
            return [F.count(v).alias("_value")], F.coalesce(F.sum(v), F.lit(0))
        case "min":
            return [F.min(v).alias("_value")], F.min(v)
        case "max":
            return [F.max(v).alias("_value")], F.max(v)
        case "avg":
            return [F.sum(v).alias("_value"), F.count(v).alias("_n")], F.try_divide(F.sum(v), F.sum(n))
        case "count_distinct":
            return [], F.count_distinct(v)
    return None


def metric(
    spec: MetricSpec,
    model: Model,
    tables: Mapping[str, DataFrame],
    dimensions: Sequence[str] | None = None,
    filters: Mapping[str, object] | None = None,
    clauses: Sequence[Mapping[str, object]] = (),
    grain: str | None = None,
    between: tuple[str | None, str | None] | None = None,
    context: str | None = None,
    row_filters: Sequence[str] = (),
    top: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Evaluate ``spec``: one row per period and dimension values.

    ``filters`` and ``clauses`` name dimensions or properties of the measured
    entity. ``row_filters`` are access predicates and always apply. ``top``
    keeps the largest values, ties broken by the dimensions.
    """
    context = resolve_context(spec, context)
    scope = spec.contexts.get(context, MetricContext()) if context else MetricContext()
    entity = model.entities[spec.entity]
    if grain is not None and grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")

    fact = tables[entity.contexts.get(context, entity.table)]
    fact = fact.alias(entity.alias or entity.name.lower())
    fact = sql_filter(fact, spec.default_filter, scope.filter, *row_filters)
    if between and spec.time_column:
        fact = time_range(fact, spec.time_column, *between)

    requested = [d.name for d in spec.dimensions] if dimensions is None else list(dimensions)
    names = list(dict.fromkeys([*requested, *scope.extra_dimensions]))
    dims = [spec.dimension(n) for n in names]

    # Filters may also name dimensions that are not grouped by.
    conditions: list[tuple[Dimension, Column]] = []
    for name, value in (filters or {}).items():
        d = spec.dimension(name)
        conditions.append((d, filter_condition({d.name: value})))
    for clause in [*scope.filters, *clauses]:
        d = spec.dimension(str(clause["field"]))
        conditions.append((d, operator_condition({**clause, "field": d.name})))

    involved = {d.name: d for d in [*dims, *[d for d, _ in conditions]]}
    local = {n: d for n, d in involved.items() if d.entity == spec.entity and not d.via}
    remote = {n: d for n, d in involved.items() if n not in local}
    paths = {n: join_path(model, spec.entity, d.entity, d.via) for n, d in remote.items()}

    # Fact projection: local dimensions, the first foreign key of each path,
    # the measure and the period.
    keys = {}
    for hops in paths.values():
        prop = hops[0][1]
        keys[f"_fk_{prop.name}"] = F.expr(prop.expression(context))
    columns = {n: property_column(entity, d.property, context) for n, d in local.items()}
    value = None
    if spec.type != "custom":
        if spec.measure_sql:
            value = F.expr(spec.measure_sql)
        elif spec.measure and entity.has(spec.measure):
            value = property_column(entity, spec.measure, context)
        elif spec.measure:
            value = F.expr(spec.measure)
    use_grain = grain is not None and grain in spec.time_grains
    if use_grain:
        columns["period"] = F.date_trunc(grain, F.col(spec.time_column)).cast("timestamp_ntz")
    groups = (["period"] if use_grain else []) + [d.name for d in dims]

    if spec.type == "custom":
        # The expression may name any fact column, so nothing is projected away
        # here; Catalyst prunes what it does not use.
        base = fact.withColumns({**columns, **keys})
    else:
        extra = {"_time": F.col(spec.time_column)} if spec.type == "latest" else {}
        base = fact.select(
            *[c.alias(n) for n, c in {**columns, **keys, **extra}.items()],
            (F.lit(1) if value is None else value).alias("_value"),
        )
    for d, condition in conditions:
        if d.name in local:
            base = base.filter(condition)

    if not remote:
        final = _aggregate(spec.type, F.col("_value") if spec.type != "custom" else None,
                           F.col("_time") if spec.type == "latest" else None, spec.measure_sql)
        result = _grouped(base, groups, final.alias(spec.name))
        return _ordered(result, spec.name, groups, top, ordered)

    step = _partial(spec.type)
    if step is not None:
        partials, final = step
        by = [n for n in [*(["period"] if use_grain else []), *local, *keys]]
        if spec.type == "count_distinct":
            base = base.select(*by, "_value").distinct()
        else:
            base = base.groupBy(*by).agg(*partials)
    else:
        final = _aggregate(spec.type, F.col("_value") if spec.type != "custom" else None,
                           F.col("_time") if spec.type == "latest" else None, spec.measure_sql)

    joined = _join_dimensions(base, model, tables, context, remote, paths)
    for d, condition in conditions:
        if d.name in remote:
            joined = joined.filter(condition)
    result = _grouped(joined, groups, final.alias(spec.name))
    return _ordered(result, spec.name, groups, top, ordered)


def _join_dimensions(base, model, tables, context, remote, paths) -> DataFrame:
    """One left join per distinct hop; hops shared by several paths join once."""
    # What each reached entity (identified by the properties followed) must
    # deliver: its dimensions and the keys of further hops.
    wanted: dict[tuple[str, ...], dict[str, Column]] = {}
    hop_of: dict[tuple[str, ...], tuple] = {}
    for name, hops in paths.items():
        at: tuple[str, ...] = ()
        for i, hop in enumerate(hops):
            at = at + (hop[1].name,)
            hop_of[at] = hop
            need = wanted.setdefault(at, {})
            if i + 1 < len(hops):
                nxt = hops[i + 1][1]
                need["_fk_" + "_".join((*at, nxt.name))] = F.expr(nxt.expression(context))
            else:
                d = remote[name]
                need[name] = property_column(model.entities[d.entity], d.property, context)
    for at in sorted(wanted, key=len):
        _, _, target, key = hop_of[at]
        entity = model.entities[target]
        side = tables[entity.contexts.get(context, entity.table)]
        key_expr = entity.property(key).expression(context)
        link = "_fk_" + "_".join(at)
        side = side.select(F.expr(key_expr).alias(link), *[c.alias(n) for n, c in wanted[at].items()])
        base = base.join(side, link, "left")
    return base


def _grouped(df: DataFrame, groups: Sequence[str], value: Column) -> DataFrame:
    return df.groupBy(*groups).agg(value) if groups else df.agg(value)


def _ordered(df: DataFrame, name: str, groups: Sequence[str], top: int | None, ordered: bool) -> DataFrame:
    if top is None and not ordered:
        return df
    keys = [F.col(name).desc_nulls_last(), *[F.col(g).asc_nulls_last() for g in groups]]
    df = df.orderBy(*keys)
    return df if top is None else df.limit(top)


def metric_set(specs: Sequence[MetricSpec], model: Model, tables: Mapping[str, DataFrame],
               dimensions: Sequence[str], context: str | None = None) -> DataFrame:
    """Several metrics of one entity and one filter in a single scan and shuffle.

    Dimensions must be properties of the entity itself.
    """
    first = specs[0]
    entity = model.entities[first.entity]
    if any(s.entity != first.entity or s.default_filter != first.default_filter for s in specs):
        raise ValueError("metrics computed together share their entity and filter")
    fact = sql_filter(tables[entity.contexts.get(context, entity.table)].alias(entity.alias or entity.name.lower()),
                      first.default_filter)
    aggregates = []
    for s in specs:
        value = None if s.type == "custom" else (
            F.expr(s.measure_sql) if s.measure_sql else property_column(entity, s.measure, context))
        time = F.col(s.time_column) if s.type == "latest" else None
        aggregates.append(_aggregate(s.type, value, time, s.measure_sql).alias(s.name))
    return fact.groupBy(*[property_column(entity, d, context).alias(d) for d in dimensions]).agg(*aggregates)


def metric_by_grain(spec: MetricSpec, model: Model, tables: Mapping[str, DataFrame], dimensions: Sequence[str] | None = None,
                    grains: Sequence[str] | None = None, **kwargs) -> DataFrame:
    """The same metric by several time grains under a ``grain`` column.

    Sums, counts and extremes are read once by day, and the other grains made
    from the days; other aggregates take a pass per grain.
    """
    grains = list(grains or spec.time_grains)
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}.get(spec.type)
    if again is None or "day" not in spec.time_grains or kwargs.get("top"):
        return reduce(DataFrame.unionByName, [metric(spec, model, tables, dimensions, grain=g, **kwargs).withColumn("grain", F.lit(g)) for g in grains])
    days = metric(spec, model, tables, dimensions, grain="day", **kwargs)
    kind = days.schema["period"].dataType
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), F.date_trunc(g, "period").cast(kind).alias("period")) for g in grains]))
    others = [c for c in days.columns if c not in ("period", spec.name)]
    wide = days.select(*others, spec.name, each.alias("_g")).select(*others, spec.name, "_g.*")
    return wide.groupBy("grain", "period", *others).agg(again(spec.name).alias(spec.name))


def metric_by_context(spec: MetricSpec, model: Model, tables: Mapping[str, DataFrame],
                      contexts: Sequence[str] | None = None, **kwargs) -> DataFrame:
    """The same metric in several contexts, side by side under a ``context`` column."""
    parts = [
        metric(spec, model, tables, context=c, **kwargs).withColumn("context", F.lit(c))
        for c in (contexts or sorted(spec.contexts))
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def resolve_requests(requests: DataFrame, catalogue: DataFrame, default: str | None = None) -> DataFrame:
    """Context of every request: given, inferred, ambiguous or unknown.

    ``requests`` has ``metric`` and nullable ``context``; ``catalogue`` has one
    row per (metric, context). Known contexts are looked up as a second left
    join, so both sides stay distributed.
    """
    per_metric = catalogue.groupBy("metric").agg(
        F.count_distinct("context").alias("_n"), F.min("context").alias("_only"))
    known = catalogue.select(F.col("context").alias("_known")).distinct()
    joined = (requests.join(per_metric, "metric", "left")
              .join(known, requests["context"] == F.col("_known"), "left"))
    given, single = F.col("context").isNotNull(), F.col("_n") == 1
    status = (F.when(given & F.col("_known").isNotNull(), "resolved")
              .when(given, "unknown_context")
              .when(single, "inferred")
              .when(F.col("_n") > 1, "ambiguous")
              .otherwise("default" if default else "unknown"))
    chosen = (F.when(given, F.col("_known")).when(single, F.col("_only"))
              .when(F.col("_n").isNull(), F.lit(default)))
    return joined.select(
        *[requests[c] for c in requests.columns if c != "context"],
        requests["context"].alias("requested"), chosen.alias("context"), status.alias("status"),
        F.coalesce(F.col("_n"), F.lit(0)).alias("candidates"))


def followed_within(events: DataFrame, id_col: str, key: str, start: str, end: str, days: int) -> DataFrame:
    """Rows for which another row of the same key starts in ``[end, end + days]``; ``id_col`` tells rows apart.

    No pairs are formed: a sweep in one read and one shuffle. Each row is a probe at its end and a
    start at its start, in buckets of a key that are ``days`` wide; a start stands in the bucket
    before its own as well, so a bucket holds every start its probes can reach, and a key with
    very many rows is as many tasks as it has buckets. Swept from the latest time on, the last start passed is the nearest
    one at or after a probe; where that is the row's own (it starts at its end, or after it), the one passed before it counts.
    """
    width = days * 86400
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width)
    kind = events.schema[end].dataType

    def point(is_start: bool, at: str, shift: int) -> Column:
        row = F.struct(*[quoted(c) for c in events.columns])
        return F.struct(F.lit(is_start).alias("_start"), F.col(at).cast(kind).alias("_t"), (bucket(at) + shift).alias("_b"),
                        F.when(F.lit(not is_start), row).alias("_row"))

    points = (events.filter(F.col(key).isNotNull())
              .select(F.col(key).alias("_k"), F.col(id_col).alias("_id"),
                      F.inline(F.array(point(False, end, 0), point(True, start, 0), point(True, start, -1)))).filter("_t IS NOT NULL"))
    # From the latest on, starts before probes of the same time.
    sweep = Window.partitionBy("_k", "_b").orderBy(F.desc("_t"), F.desc("_start"))
    passed = lambda *more: F.last(F.when(F.col("_start"), F.struct("_t", "_id", *more)), ignorenulls=True)
    points = points.withColumn("_later", passed().over(sweep.rowsBetween(Window.unboundedPreceding, -1)))
    points = points.withColumn("_near", passed("_later").over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    nearest = F.when(F.col("_near._id") != F.col("_id"), F.col("_near._t")).otherwise(F.col("_near._later._t"))
    return points.filter(~F.col("_start") & (nearest <= F.col("_t") + F.expr(f"INTERVAL {days} DAYS"))).select("_row.*")


def in_cohort(df: DataFrame, key: str, cohort: DataFrame, cohort_key: str, condition: str) -> DataFrame:
    """Rows whose key belongs to the cohort (``key IN (SELECT …)``)."""
    members = cohort.filter(F.expr(condition)).select(F.col(cohort_key).alias(key))
    return df.join(members, key, "left_semi")
