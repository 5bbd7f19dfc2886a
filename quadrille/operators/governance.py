"""Access decisions, row filters, masking, tenancy, retention and consent."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille import vocab
from quadrille.functions.columns import quoted, sql_filter

# Clearance levels, lowest first (fixed values). The last two count as high.
CLEARANCES = ("public", "internal", "confidential", "restricted", "top_secret")
HIGH = ("restricted", "top_secret")


# Up to so many rules are one expression; more are a table.
INLINE_RULES = 200


def decide(requests: DataFrame, rules: Sequence[tuple[str, str | None, str | None]]) -> DataFrame:
    """Adds ``allow`` to requests with ``role``, ``action`` and ``context``.

    A rule is (role, action, context), None allowing any; what no rule allows is
    denied. The caller's rules are a condition on the request itself, in the same pass as
    whatever reads it; a long list becomes one row per role, so a request is matched
    once and never multiplied. A missing role is a denial.
    """
    rules = sorted(set(rules), key=repr)
    if len(rules) <= INLINE_RULES:
        each = [reduce(Column.__and__, [F.col(name) == value for name, value in zip(("role", "action", "context"), rule, strict=True)
                                        if value is not None or name == "role"]) for rule in rules]
        allowed = reduce(Column.__or__, each, F.lit(False))
        return requests.withColumn("allow", F.coalesce(allowed, F.lit(False)))
    table = requests.sparkSession.createDataFrame(rules, "role string, _action string, _context string")
    per_role = table.groupBy("role").agg(F.collect_list(F.struct("_action", "_context")).alias("_rules"))
    hit = F.exists("_rules", lambda r: (r["_action"].isNull() | (r["_action"] == F.col("action")))
                   & (r["_context"].isNull() | (r["_context"] == F.col("context"))))
    # One row per role named in the rules the caller wrote.
    return requests.join(F.broadcast(per_role), "role", "left").withColumn(
        "allow", F.coalesce(hit, F.lit(False))).drop("_rules")


def clearance_rank(level: Column) -> Column:
    """Position among the levels, 1 for public; null for an unknown level."""
    return F.nullif(F.array_position(F.array(*[F.lit(c) for c in CLEARANCES]), level), F.lit(0).cast("long"))


def decide_by_policy(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds ``allow``: the role is listed for the action and the clearance suffices.

    An unknown or missing level, of the reader or of the policy, denies.

    ``requests``: ``policy``, ``role``, ``action``, ``clearance``; ``policies``:
    ``policy``, ``read`` and ``write`` arrays, ``required`` clearance.
    """
    listed = F.when(F.col("action") == "write", F.array_contains("write", F.col("role"))).when(
        F.col("action") == "read", F.array_contains("read", F.col("role")))
    enough = clearance_rank(F.col("clearance")) >= clearance_rank(F.col("required"))
    return requests.join(policies, "policy", "left").withColumn(
        "allow", F.coalesce(listed & enough, F.lit(False))).select(*requests.columns, "allow")


_TENANT = re.compile(r"'\{\{\s*tenant\s*\}\}'|\{\{\s*tenant\s*\}\}")


def _bind_tenant(text: str, tenant: str) -> str:
    literal = "'" + tenant.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return _TENANT.sub(lambda m: literal, text)


def row_filter(df: DataFrame, role: str, tenant: str, columns: Mapping[str, str] | None = None,
               predicates: Mapping[str, str] | None = None) -> DataFrame:
    """Applies the filters of a policy, AND-ed.

    ``columns``: column and the value it has to equal; a column that the table
    does not have is an error, never an open door. ``predicates``: role and the
    SQL predicate that applies to it. ``{{tenant}}`` stands for the caller's
    tenant, always as a literal.
    """
    absent = sorted(set(columns or {}) - set(df.columns))
    if absent:
        raise ValueError(f"row filter on unknown columns: {', '.join(absent)}")
    for name, value in (columns or {}).items():
        df = df.filter(quoted(name) == F.lit(tenant if _TENANT.fullmatch(value) else value))
    return sql_filter(df, _bind_tenant(predicates[role], tenant)) if role in (predicates or {}) else df


def mask(df: DataFrame, role: str, clearance: str, fields: Sequence[str], unmasked_roles: Sequence[str] = ()) -> DataFrame:
    """Listed fields become ``***`` unless the reader may see them; absent ones are ignored."""
    if clearance in HIGH or role in unmasked_roles:
        return df
    return df.withColumns({f: F.lit("***") for f in fields if f in df.columns})


def own_graphs(df: DataFrame, tenant: str | Column, graph: str = "graph", scheme: str = vocab.SCHEME) -> DataFrame:
    """Rows of the tenant's own namespace and the global one."""
    name = F.lit(tenant) if isinstance(tenant, str) else tenant
    g = F.col(graph)
    return df.filter(g.startswith(F.concat(F.lit(f"{scheme}://"), name, F.lit("/"))) | g.startswith(f"{scheme}://global/"))


def region_filter(df: DataFrame, region: str | None, column: str = "region") -> DataFrame:
    """Restricts rows to the reader's region, when the reader has one."""
    return df if region is None else df.filter(F.col(column) == region)


@dataclass(frozen=True)
class FieldPolicy:
    """Where and from which clearance a field may be seen."""

    field: str
    contexts: tuple[str, ...] = ()
    clearance: str = "public"


def visible_fields(df: DataFrame, policies: Sequence[FieldPolicy], context: str, clearance: str, masked: bool = False) -> DataFrame:
    """Drops (or masks) fields hidden in the context or above the clearance."""
    rank = CLEARANCES.index(clearance)
    hidden = [p.field for p in policies if p.field in df.columns
              and ((p.contexts and context not in p.contexts) or CLEARANCES.index(p.clearance) > rank)]
    return df.withColumns({f: F.lit("***") for f in hidden}) if masked else df.drop(*hidden)


def retain(df: DataFrame, kind: str, time: str, now: Column, years: Mapping[str, int]) -> DataFrame:
    """Drops rows older than the retention of their kind; kinds without one stay.

    Written as one bound per kind, so that the time filter reaches the scan.
    """
    bounds = [~((F.col(kind) == k) & (F.col(time) < F.add_months(now, -12 * y).cast(df.schema[time].dataType)))
              for k, y in years.items()]
    for b in bounds:
        df = df.filter(F.coalesce(b, F.lit(True)))
    return df


def consented(df: DataFrame, key: str, consents: DataFrame, context: str, sensitive: Sequence[str]) -> DataFrame:
    """In sensitive contexts only rows whose subject consented (``consents`` has the key)."""
    if context not in sensitive:
        return df
    return df.join(consents.select(key), key, "left_semi")
