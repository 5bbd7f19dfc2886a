import random

import pytest
from pyspark.sql import functions as F

from quadrille import vocab
from quadrille.operators import patterns as P
from quadrille.operators import shapes as S
from quadrille.operators import traverse as V
from quadrille.operators import triples as T
from quadrille.vocab import QUAD_DDL, TYPE, XSD
from tests.conftest import rows


def make(spark, *quads):
    """(s, p, o) with o an IRI, or (s, p, o, datatype or '@lang' or 'string')."""
    out = []
    for s, p, o, *rest in quads:
        graph = "g"
        if len(rest) > 1:
            graph = rest[1]
        if rest and rest[0]:
            kind = rest[0]
            out.append((s, p, o, "literal", None if kind in ("string",) or kind.startswith("@") else kind,
                        kind[1:] if kind.startswith("@") else None, graph))
        else:
            out.append((s, p, o, "iri", None, None, graph))
    return spark.createDataFrame(out, QUAD_DDL)


@pytest.mark.parametrize("kind,xsd", [("bigint", "integer"), ("decimal(9,2)", "decimal"), ("double", "decimal"), ("boolean", "boolean"),
                                      ("timestamp", "dateTime"), ("timestamp_ntz", "dateTime"), ("date", "date"), ("string", None)])
def test_type_map(spark, kind, xsd):
    assert T.xsd_type(spark.sql(f"SELECT cast(null AS {kind}) AS v").schema["v"].dataType) == (XSD + xsd if xsd else None)


def test_numbers_and_times_in_full(spark):
    from datetime import datetime
    from decimal import Decimal

    df = spark.createDataFrame([(0.000012345, Decimal("0.123456789012345678"), datetime(2024, 1, 1, 12, 0, 0, 500000)),
                                (1e15, Decimal("-12345678901234567890.5"), datetime(2024, 1, 1)), (-2.5e-20, None, None), (1e22, None, None)],
                               "x double, d decimal(38,18), t timestamp_ntz")
    lexical = df.select(T.lexical(F.col("x"), XSD + "decimal"), T.lexical(F.col("d"), XSD + "decimal"), T.lexical(F.col("t"), XSD + "dateTime"))
    assert [tuple(r) for r in lexical.collect()] == [
        ("0.000012345", "0.123456789012345678", "2024-01-01T12:00:00.5"), ("1000000000000000.0", "-12345678901234567890.500000000000000000", "2024-01-01T00:00:00"),
        ("-0.000000000000000000025", None, None), ("10000000000000000000000.0", None, None)]


def test_null_cells_give_no_triple_and_decimals_no_exponent(spark):
    df = spark.createDataFrame([(1, 12345678.5, None), (2, None, True)], "id int, x double, b boolean")
    m = T.RowMapping("r/{id}", ("C",), (T.Field("x", "p/x", XSD + "decimal"), T.Field("b", "p/b", XSD + "boolean")))
    got = rows(T.rows_to_triples(df, m), "subject", "predicate", "object")
    assert got == [("r/1", "p/x", "12345678.5"), ("r/1", TYPE, "C"), ("r/2", "p/b", "true"), ("r/2", TYPE, "C")] or set(got) == {
        ("r/1", "p/x", "12345678.5"), ("r/1", TYPE, "C"), ("r/2", "p/b", "true"), ("r/2", TYPE, "C")}


def test_match_tells_terms_apart(spark):
    q = make(spark, ("a", "p", "1", XSD + "integer"), ("b", "p", "1", "string"), ("c", "p", "1", "@en"), ("d", "p", "1"), ("e", "q", "1", XSD + "integer"))
    found = P.match(q, [("?x", "p", "?v"), ("?y", "q", "?v")])
    assert rows(found, "x", "y") == [("a", "e")]
    assert rows(P.match(q, [("?x", "p", P.Literal("1"))])) == [("a",), ("b",), ("c",)]
    assert rows(P.match(q, [("?x", "p", P.Literal("1", lang="en"))])) == [("c",)]
    assert rows(P.match(q, [("?x", "p", "1")])) == [("d",)]


def test_match_joins_nodes_not_literals(spark):
    q = make(spark, ("a", "knows", "b"), ("a", "says", "b", "string"), ("b", "name", "B", "string"))
    assert rows(P.match(q, [("?x", "?p", "?y"), ("?y", "name", "?n")]), "x", "p", "n") == [("a", "knows", "B")]


def test_match_repeated_variable_and_constant_pattern(spark):
    q = make(spark, ("a", "p", "a"), ("a", "p", "b"), ("x", "y", "z"))
    assert rows(P.match(q, [("?s", "p", "?s")])) == [("a",)]
    assert P.match(q, [("?s", "p", "?s"), ("x", "y", "z")]).count() == 1
    assert P.match(q, [("?s", "p", "?s"), ("x", "y", "none")]).count() == 0


def test_match_refuses_cross_products(spark):
    with pytest.raises(ValueError):
        P.match(make(spark, ("a", "p", "b")), [("?a", "p", "?b"), ("?c", "p", "?d")])


def test_graph_variable_keeps_solutions_in_one_graph(spark):
    q = make(spark, ("a", "p", "b", None, "g1"), ("b", "p", "c", None, "g2"), ("b", "p", "d", None, "g1"))
    assert rows(P.match(q, [("?x", "p", "?y"), ("?y", "p", "?z")], graph="?g"), "x", "z", "g") == [("a", "d", "g1")]
    assert P.match(q, [("?x", "p", "?y"), ("?y", "p", "?z")]).count() == 2


def test_optional_path_and_ask(spark):
    q = make(spark, ("a", "p", "b"), ("b", "q", "c"), ("d", "p", "e"))
    assert rows(P.optional(P.match(q, [("?x", "p", "?y")]), q, [("?y", "q", "?z")]), "x", "z") == [("a", "c"), ("d", None)]
    assert rows(P.path(q, "?s", ["p", "q"], "?o")) == [("a", "c")]
    assert P.ask(P.match(q, [("a", "p", "?y")])) and not P.ask(P.match(q, [("z", "p", "?y")]))


def test_graph_maintenance(spark, tmp_path):
    q = make(spark, ("a", "p", "b", None, "g1"), ("a", "p", "c", None, "g2"))
    assert T.graph_exists(q, "g1") and not T.graph_exists(q, "g9")
    assert rows(T.graph_counts(T.drop_graph(q, "g1"))) == [("g2", 1)]
    assert T.graph_counts(q.limit(0)).count() == 0
    path = str(tmp_path / "quads")
    assert rows(T.append_quads(q.union(q), path)) == [("g1", 1), ("g2", 1)]
    assert T.append_quads(q, path).count() == 0
    assert T.read_quads(spark, path).count() == 2


def test_upserts(spark):
    n = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 2, None, 2.0), ("b", 1, None, None)], "iri string, seq int, name string, score double")
    assert rows(T.upsert_nodes(n)) == [("a", "x", 2.0), ("b", None, None)]
    m = spark.createDataFrame([("a", 1, {"k": "1", "l": "2"}), ("a", 2, {"k": "3", "l": None}), ("b", 1, {})],
                              "iri string, seq int, properties map<string,string>")
    assert {r["iri"]: r["properties"] for r in T.upsert_property_maps(m).collect()} == {"a": {"k": "3", "l": "2"}, "b": {}}
    e = spark.createDataFrame([("a", "t", "b", 1, "old"), ("a", "t", "b", 2, "new"), ("a", "t", "z", 3, "x")],
                              "from_iri string, edge_type string, to_iri string, seq int, note string")
    assert rows(T.merge_edges(e, n), "from_iri", "to_iri", "note") == [("a", "b", "new")]


def test_align_predicates(spark):
    q = make(spark, ("a", "http://x/name", "n", "string"), ("a", "http://x#age", "3", "string"), ("a", "http://x/other", "o", "string"))
    mapping = spark.createDataFrame([("name", "http://y/label", True), ("http://x#age", None, False)],
                                    "source_field string, target_property string, accepted boolean")
    assert rows(T.align_predicates(q, mapping), "predicate", "quarantined") == [
        ("http://x#age", True), ("http://x/other", False), ("http://y/label", False)]


def _random_edges(seed, n, m):
    rng = random.Random(seed)
    # Node 0 is a hub with a third of the edges.
    return [(0 if i % 3 == 0 else rng.randrange(n), rng.randrange(n)) for i in range(m)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_by_brute_force(spark, seed):
    edges = _random_edges(seed, 120, 70) + [(i, i + 1) for i in range(200, 260)] + [(300, 300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((x, find(x)) for x in list(parent))
    got = sorted(tuple(r) for r in V.components(spark.createDataFrame(edges, "src int, tgt int")).collect())
    assert got == want


def test_reach_by_brute_force_with_cycles(spark):
    edges = _random_edges(5, 30, 45)
    want, links = {}, {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
    for start in links:
        depth, frontier, seen = 0, {start}, {}
        while frontier:
            depth += 1
            frontier = {t for s in frontier for t in links.get(s, ())} - set(seen)
            seen.update({t: depth for t in frontier})
        want.update({(start, t): d for t, d in seen.items()})
    got = {(r[0], r[1]): r[2] for r in V.reach(spark.createDataFrame(edges, "src int, tgt int")).collect()}
    assert got == want


def test_traverse_gives_each_edge_once_at_its_smallest_depth(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a"), ("b", "s", "c"), ("a", "r", "c"), ("c", "r", "d")], "src string, rel string, tgt string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    got = rows(V.traverse(e, seeds, 3), "src", "rel", "tgt", "depth")
    assert got == [("a", "r", "b", 1), ("a", "r", "c", 1), ("b", "r", "a", 2), ("b", "s", "c", 2), ("c", "r", "d", 2)]
    assert rows(V.traverse(e, seeds, 1, ["s"])) == []
    with pytest.raises(ValueError):
        V.traverse(e, seeds, 0)


def test_rdfs_closure(spark):
    sub, prop = vocab.SUBCLASS, vocab.SUBPROPERTY
    q = make(spark, ("A", sub, "B"), ("B", sub, "C"), ("p", prop, "q"), ("q", vocab.DOMAIN, "D"), ("q", vocab.RANGE, "A"), ("x", "p", "y"))
    got = {(r["subject"], r["predicate"], r["object"]) for r in V.rdfs_closure(q).collect()}
    assert {("A", sub, "C"), ("x", "q", "y"), ("x", TYPE, "D"), ("y", TYPE, "A"), ("y", TYPE, "B"), ("y", TYPE, "C")} <= got
    assert len(got) == 12


def test_import_closure_visits_each_once(spark):
    imports = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", "y")], "src string, tgt string")
    roots = spark.createDataFrame([("a",)], "src string")
    assert rows(V.import_closure(imports, roots), "document", "depth") == [("a", 0), ("b", 1), ("c", 2)]


ACCOUNT = "https://f/BankAccount"
SHAPES = [S.Shape(ACCOUNT, "f:id", 1, None, XSD + "string", message="an identifier is required"),
          S.Shape(ACCOUNT, "f:balance", None, 1, XSD + "decimal")]


def test_conforming_account(spark):
    q = make(spark, ("acc1", TYPE, ACCOUNT), ("acc1", "f:id", "ACC-001", XSD + "string"), ("acc1", "f:balance", "50000.00", XSD + "decimal"))
    assert S.conforms(S.validate(q, SHAPES))


def test_missing_identifier(spark):
    q = make(spark, ("acc2", TYPE, ACCOUNT), ("acc2", "f:balance", "25000.00", XSD + "decimal"))
    report = S.validate(q, SHAPES)
    assert not S.conforms(report)
    r = report.first()
    assert (r["focus"], r["component"], r["message"], r["severity"]) == ("acc2", "minCount", "an identifier is required", "Violation")


def test_every_component_and_subclasses(spark):
    shapes = [S.Shape("C", "n", max_count=1), S.Shape("C", "d", datatype=XSD + "integer"), S.Shape("C", "r", pattern="^[A-Z]{3}$"),
              S.Shape("C", "i", values=("a", "b")), S.Shape("C", "k", node_class="K"), S.Shape("C", "o", node_kind="IRI"),
              S.Shape("C", "m", min_count=2)]
    q = make(spark, ("Sub", vocab.SUBCLASS, "C"), ("x", TYPE, "Sub"), ("x", "n", "1", "string"), ("x", "n", "2", "string"),
             ("x", "d", "12", XSD + "integer"), ("x", "d", "1x", XSD + "integer"), ("x", "d", "7", "string"), ("x", "r", "EUR", "string"),
             ("x", "r", "eur", "string"), ("x", "i", "c", "string"), ("x", "k", "y"), ("x", "k", "z"), ("y", TYPE, "K"),
             ("x", "o", "lit", "string"), ("x", "m", "1", "string"),
             # the same value in another graph is one value
             ("x", "m", "1", "string", "g2"))
    got = rows(S.validate(q, shapes), "path", "component", "value")
    assert got == sorted([("n", "maxCount", None), ("d", "datatype", "1x"), ("d", "datatype", "7"), ("r", "pattern", "eur"),
                          ("i", "in", "c"), ("k", "class", "z"), ("o", "nodeKind", "lit"), ("m", "minCount", None)], key=repr)
    assert S.conforms(S.validate(q, shapes, with_subclasses=False))


def test_zero_has_no_sign_in_patterns(spark):
    q = make(spark, ("a", TYPE, "C"), *[("a", "p", v, XSD + "decimal") for v in ("-0.0", "-0", "-.0", "0.0", "-0.5")], ("a", "p", "-0.0", XSD + "string"))
    report = S.validate(q, [S.Shape("C", "p", pattern=r"^[0-9.]")])
    # Of the decimals only the negative one fails; in a text the sign is a character like any other.
    assert rows(report, "component", "value") == [("pattern", "-0.0"), ("pattern", "-0.5")]


def test_quarantine_split(spark):
    q = make(spark, ("a", TYPE, ACCOUNT), ("http://b", TYPE, ACCOUNT), ("http://b", "f:id", "1", XSD + "string"))
    report = S.validate(q, SHAPES)
    kept, held = S.split_quarantine(q, report)
    assert {r["subject"] for r in kept.collect()} == {"http://b"} and {r["subject"] for r in held.collect()} == {"a"}
    triples = S.quarantine_triples(report, "held")
    assert triples.count() == 3 and triples.filter("object = 'a'").first()["object_kind"] == "literal"
    # Node names are hashes of the content, so a rerun writes the same ones.
    assert rows(triples) == rows(S.quarantine_triples(S.validate(q, SHAPES), "held"))


@pytest.mark.parametrize("name,good,bad", [
    ("integer", ["1", "-07"], ["1.0", "", "x"]), ("decimal", ["1", "1.5", ".5", "-2."], ["1e3", "."]), ("boolean", ["true", "0"], ["yes"]),
    ("date", ["2024-02-29"], ["2023-02-29", "24-1-1"]), ("dateTime", ["2024-01-01T10:00:00"], ["2024-01-01", "2024-13-01T00:00:00"])])
def test_lexical_forms(spark, name, good, bad):
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    got = {r[0]: r[1] for r in df.select("v", S.well_formed(F.col("v"), XSD + name)).collect()}
    assert got == {**{v: True for v in good}, **{v: False for v in bad}}


def test_graphs_are_one_set_unless_named(spark):
    q = make(spark, ("a", "p", "b", "", "g1"), ("a", "p", "b", "", "g2"), ("b", "q", "5", "string", "g1"), ("b", "q", "5", "string", "g2"))
    found = P.match(q, [("?x", "p", "?y"), ("?y", "q", "?n")])
    assert rows(found, "x", "y", "n") == [("a", "b", "5")]
    assert P.match(q, [("?x", "p", "?y"), ("?y", "q", "?n")], "?g").count() == 2


def test_tables_mapped_into_two_graphs_are_one_set(spark):
    people = spark.createDataFrame([(1, "Ann", 10), (2, "Bo", 20)], "id int, name string, town int")
    m = T.RowMapping("p/{id}", ("Person",), (T.Field("name", "name"),), (T.Link("town", "t/{town}"),), unique=True)
    source = T.mapped({"a": people, "b": people}, {"a": m, "b": m}, {"a": "g1", "b": "g2"})
    pattern = [("?p", TYPE, "Person"), ("?p", "name", "?n"), ("?p", "town", "?t")]
    assert rows(P.match(source, pattern), "p", "n", "t") == [("p/1", "Ann", "t/10"), ("p/2", "Bo", "t/20")]
    assert P.match(source, pattern, "?g").count() == 4
    alone = T.mapped({"a": people}, {"a": m}, {"a": "g1"})
    assert not alone.repeats(["name"]) and source.repeats(["name"]) and source.repeats(None)


def test_rates_count_subclass_members(spark):
    q = make(spark, ("c:Sub", vocab.SUBCLASS, "c:Top"), ("a", TYPE, "c:Top"), ("b", TYPE, "c:Sub"), ("d", TYPE, "c:Sub"), ("d", TYPE, "c:Top"))
    shapes = [S.Shape("c:Top", "p", min_count=1)]
    rate = S.violation_rates(S.validate(q, shapes), q, shapes).first()
    assert (rate["failing"], rate["nodes"], rate["rate"]) == (3, 3, 1.0)


def test_stars_over_tables_equal_joins_of_quads(spark):
    from dataclasses import replace

    people = spark.createDataFrame([(1, "Ann", 10, 3.0), (2, "Bo", 20, None), (3, None, 10, 1.0)], "id int, name string, town int, x double")
    towns = spark.createDataFrame([(10, "A"), (20, "Bo")], "id int, name string")
    mappings = {
        "people": T.RowMapping("p/{id}", ("Person",), (T.Field("name", "name"), T.Field("x", "x", XSD + "decimal")), (T.Link("town", "t/{town}"),), unique=True),
        "towns": T.RowMapping("t/{id}", ("Town",), (T.Field("name", "name"),), unique=True)}
    tables = {"people": people, "towns": towns}
    source = T.mapped(tables, mappings, {"people": "g1", "towns": "g2"})
    stored = source(None)
    assert source.star(["name", "town"]) is not None and source.star(["town", "name", TYPE]) is not None
    loose = T.mapped(tables, {n: replace(m, unique=False) for n, m in mappings.items()}, {})
    assert loose.star(["name", "town"]) is None
    for pattern in ([("?p", TYPE, "Person"), ("?p", "name", "?n"), ("?p", "town", "?t"), ("?t", "name", "?m"), ("?t", TYPE, "?c")],
                    [("?p", "name", "?n"), ("?p", "town", "?t"), ("?t", "name", "?n")], [("?a", "name", "?n"), ("?a", TYPE, "?c")],
                    [("?p", "x", "?x"), ("?p", "town", "t/10")], [("?p", "name", P.Literal("Bo")), ("?p", TYPE, "Town")]):
        a, b = P.match(source, pattern), P.match(stored, pattern)
        order = sorted(a.columns)
        assert sorted(b.columns) == order and rows(a, *order) == rows(b, *order)
        for graph in ("g1", "?g"):
            a, b = P.match(source, pattern, graph), P.match(stored, pattern, graph)
            assert rows(a, *sorted(a.columns)) == rows(b, *sorted(b.columns))


def distances(edges, starts=None):
    links, want = {}, set()
    for s, t in edges:
        links.setdefault(s, set()).add(t)
    for start in starts if starts is not None else links:
        depth, seen, frontier = 0, {}, {start}
        while frontier:
            depth += 1
            frontier = {t for s in frontier for t in links.get(s, ())} - set(seen)
            seen.update({t: depth for t in frontier})
        want |= {(start, t, d) for t, d in seen.items()}
    return want


def rounds_of(monkeypatch):
    made = []
    own = V.materialise
    monkeypatch.setattr(V, "materialise", lambda df, name="step": made.append(name) or own(df, name))
    return made


def test_long_paths_double(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(300)] + [(300, 250), (7, 90)]
    made = rounds_of(monkeypatch)
    got = {tuple(r) for r in V.reach(spark.createDataFrame(edges, "src int, tgt int")).collect()}
    assert got == distances(edges)
    assert made.count("reach") <= 11


def test_seeds_cross_long_stretches_in_few_rounds(spark, monkeypatch):
    # A chain of 10,000 links with a shortcut, a side branch, a way back to the seed, and a ring nobody reaches.
    edges = [(i, i + 1) for i in range(10_000)] + [(40, 6000), (2000, -1), (-1, -2), (-2, -3), (10_000, 0)] + [(-10 - i, -10 - (i + 1) % 9) for i in range(9)]
    made = rounds_of(monkeypatch)
    got = {tuple(r) for r in V.reach(spark.createDataFrame(edges, "src int, tgt int"), spark.createDataFrame([(0,), (5,), (77_777,)], "src int")).collect()}
    assert got == distances(edges, [0, 5])
    assert made.count("stretch") <= 16 and len(made) < 45


@pytest.mark.parametrize("seed", range(4))
def test_seeded_stretches_by_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(V, "PATIENCE", 1)
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(60) if rng.random() < 0.95] + [(rng.randrange(60), rng.randrange(60)) for _ in range(6)]
    seeds = rng.sample(range(60), 3)
    got = {tuple(r) for r in V.reach(spark.createDataFrame(edges, "src int, tgt int"), spark.createDataFrame([(s,) for s in seeds], "src int")).collect()}
    assert got == distances(edges, seeds)
