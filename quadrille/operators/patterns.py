"""Basic graph patterns as joins of the quad table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.triples import QuadSource, graph_type, of_predicates

Pattern = tuple


@dataclass(frozen=True)
class Literal:
    """A constant literal in object position; without a datatype any matches."""

    value: str
    datatype: str | None = None
    lang: str | None = None


def is_variable(term: object) -> bool:
    return isinstance(term, str) and term.startswith("?")


def _constrained(quads: DataFrame, pattern: Pattern, get: Callable[[str], Column], columns: dict[str, Column],
                 as_node: set[str], as_term: set[str]) -> DataFrame:
    """Filters for the constants of a pattern whose quad ``get`` reads; its variables are added to ``columns``."""
    identity = F.concat_ws("|", get("object_kind"), F.coalesce(get("datatype"), F.lit("")), F.coalesce(get("lang"), F.lit("")))
    for position, term in zip(("subject", "predicate", "object"), pattern):
        col = get(position)
        if isinstance(term, Literal):
            quads = quads.filter((col == term.value) & (get("object_kind") == "literal"))
            if term.datatype:
                quads = quads.filter(get("datatype") == term.datatype)
            if term.lang:
                quads = quads.filter(get("lang") == term.lang)
        elif is_variable(term):
            name = term[1:]
            if position == "object" and name in as_node:
                quads = quads.filter(get("object_kind") != "literal")
            if name in columns:
                quads = quads.filter(columns[name] == col)
                if position == "object" and f"_id_{name}" in columns:
                    quads = quads.filter(columns[f"_id_{name}"] == identity)
            else:
                columns[name] = col
                if position == "object" and name in as_term:
                    # What beside the value makes two object terms equal.
                    columns[f"_id_{name}"] = identity
        else:
            quads = quads.filter(col == term)
            if position == "object":
                quads = quads.filter(get("object_kind") != "literal")
    return quads


def _bindings(source: QuadSource, pattern: Pattern, as_node: set[str], as_term: set[str], graph: str | None) -> DataFrame:
    """Solutions of one pattern: a filter and a projection of the quad table."""
    columns: dict[str, Column] = {}
    quads = scope(of_predicates(source, None if is_variable(pattern[1]) else [pattern[1]]), graph)
    quads = _constrained(quads, pattern, F.col, columns, as_node, as_term)
    if is_variable(graph):
        columns[graph[1:]] = F.col("graph")
    # A fully constant pattern still restricts the result.
    if not columns:
        return quads.select(F.lit(1).alias("_ask")).limit(1)
    return quads.select(*[c.alias(n) for n, c in columns.items()])


def _star(source: QuadSource, patterns: Sequence[Pattern], as_node: set[str], as_term: set[str], graph: str | None) -> DataFrame | None:
    """Solutions of all patterns on one subject from single rows, where the source can tell; else None."""
    predicates = [p for _, p, _ in patterns]
    if len(patterns) < 2 or not hasattr(source, "star") or len(set(predicates)) < len(predicates) or any(map(is_variable, predicates)) or is_variable(graph):
        return None
    rows = source.star(predicates)
    if rows is None:
        return None
    columns: dict[str, Column] = {}
    for i, pattern in enumerate(patterns):
        get = lambda part, i=i: F.col(f"q{i}.{part}")
        rows = rows.filter(get("subject").isNotNull() & get("object").isNotNull())
        if graph is not None:
            rows = rows.filter(get("graph") == graph)
        rows = _constrained(rows, pattern, get, columns, as_node, as_term)
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def _roles(patterns: Sequence[Pattern]) -> tuple[set[str], set[str]]:
    """Variables that must be nodes, and object variables compared as whole terms."""
    nodes, objects = set(), Counter()
    for s, p, o in patterns:
        nodes |= {t[1:] for t in (s, p) if is_variable(t)}
        if is_variable(o):
            objects[o[1:]] += 1
    return nodes, {v for v, n in objects.items() if n > 1 and v not in nodes}


def _order(patterns: Sequence[Pattern]) -> list[Pattern]:
    """Most constants first, then always one connected to what is bound."""
    constants = lambda p: sum(not is_variable(t) for t in p)
    variables = lambda p: {t[1:] for t in p if is_variable(t)}
    ground = [p for p in patterns if not variables(p)]
    left, result, bound = [p for p in patterns if variables(p)], [], set()
    while left:
        linked = [p for p in left if not bound or variables(p) & bound]
        if not linked:
            raise ValueError("patterns are not connected; join them explicitly")
        best = max(linked, key=constants)
        result.append(best)
        left.remove(best)
        bound |= variables(best)
    return result + ground


def scope(quads: DataFrame, graph: str | None = None, kind: str | None = None) -> DataFrame:
    """One named graph, or all graphs of one type."""
    if graph is not None and not is_variable(graph):
        quads = quads.filter(F.col("graph") == graph)
    if kind is not None:
        quads = quads.filter(graph_type(F.col("graph")) == kind)
    return quads


def _may_repeat(quads: QuadSource, predicates: Sequence) -> bool:
    """Whether a source may hold a triple of these predicates twice; a function that cannot tell sees to it itself."""
    if isinstance(quads, DataFrame):
        return True
    known = None if any(is_variable(p) for p in predicates) else list(predicates)
    return bool(getattr(quads, "repeats", lambda _: False)(known))


def match(quads: QuadSource, patterns: Sequence[Pattern], graph: str | None = None) -> DataFrame:
    """Solutions of a basic graph pattern, one column per variable.

    Terms: ``?name`` is a variable, other strings are IRIs, ``Literal`` a
    constant value. ``graph`` is a graph name, or ``?g`` to require one common
    graph and return it; without it the graphs count as one set, in which a
    triple stands once, also where tables are mapped into several graphs. All patterns on one subject join on the same key, so
    Spark shuffles each of them once and never the intermediate result again.
    """
    nodes, terms = _roles(patterns)
    result, ordered, done = None, _order(patterns), set()
    for at, pattern in enumerate(ordered):
        if at in done:
            continue
        # Patterns on one subject that single rows of a table answer are one step.
        own = [i for i in range(at, len(ordered)) if ordered[i][0] == pattern[0]] if is_variable(pattern[0]) else [at]
        step = _star(quads, [ordered[i] for i in own], nodes, terms, graph)
        step_of_rows = step is not None
        if step_of_rows:
            done.update(own)
        else:
            step = _bindings(quads, pattern, nodes, terms, graph)
        if graph is None and "_ask" not in step.columns and _may_repeat(quads, [ordered[i][1] for i in (own if step_of_rows else [at])]):
            step = step.distinct()
        if result is None:
            result = step
        elif "_ask" in step.columns:
            result = result.join(F.broadcast(step), F.lit(True), "left_semi")
        else:
            result = result.join(step, [c for c in step.columns if c in result.columns], "inner")
    return result.drop(*[c for c in result.columns if c.startswith("_id_") or c == "_ask"])


def optional(solutions: DataFrame, quads: QuadSource, patterns: Sequence[Pattern], graph: str | None = None) -> DataFrame:
    """Left join with further patterns on the shared variables."""
    right = match(quads, patterns, graph)
    shared = [c for c in right.columns if c in solutions.columns]
    if not shared:
        raise ValueError("an optional part must share a variable")
    return solutions.join(right, shared, "left")


def union(branches: Sequence[DataFrame]) -> DataFrame:
    """Bag union; variables missing from a branch stay unbound."""
    result = branches[0]
    for branch in branches[1:]:
        result = result.unionByName(branch, allowMissingColumns=True)
    return result


def path(quads: QuadSource, start: str, predicates: Sequence[str], end: str, graph: str | None = None) -> DataFrame:
    """Sequence path ``p/q/r`` from ``start`` to ``end`` (variables or IRIs)."""
    stops = [start, *[f"?_hop{i}" for i in range(1, len(predicates))], end]
    steps = [(a, p, b) for a, p, b in zip(stops, predicates, stops[1:])]
    result = match(quads, steps, graph)
    return result.drop(*[s[1:] for s in stops[1:-1]])


def ask(solutions: DataFrame) -> bool:
    """Whether there is any solution."""
    return not solutions.limit(1).isEmpty()
