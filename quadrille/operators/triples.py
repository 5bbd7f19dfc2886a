"""Quad tables: building them from rows, maintaining them, reading them back."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille import vocab
from quadrille.functions.columns import iso_time, local_name, plain_number, quoted, template
from quadrille.session import deal, materialise
from quadrille.vocab import QUAD_COLUMNS, TYPE

# Quads are a table, or a function from a list of predicates (None for all) to
# one. The function lets a mapped source build only what a pattern can use.
QuadSource = DataFrame | Callable[[Sequence[str] | None], DataFrame]


def of_predicates(quads: QuadSource, predicates: Sequence[str] | None) -> DataFrame:
    """The quads with these predicates, all without a list."""
    if not isinstance(quads, DataFrame):
        quads = quads(predicates)
    return quads if predicates is None else quads.filter(F.col("predicate").isin(list(predicates)))


def xsd_type(kind: T.DataType) -> str | None:
    """XSD datatype IRI of a Spark type; text and nested types have none."""
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return vocab.XSD + "decimal"
    names = {T.IntegralType: "integer", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime"}
    return next((vocab.XSD + name for base, name in names.items() if isinstance(kind, base)), None)


@dataclass(frozen=True)
class Field:
    """A column that becomes a literal-valued triple."""

    column: str
    predicate: str
    datatype: str | None = None
    lang: str | None = None
    values: Mapping[str, str] | None = None


@dataclass(frozen=True)
class Link:
    """A column that becomes an IRI-valued triple through a target template."""

    predicate: str
    target: str


@dataclass(frozen=True)
class RowMapping:
    subject: str
    classes: tuple[str, ...]
    fields: tuple[Field, ...] = ()
    links: tuple[Link, ...] = ()
    # Whether each row has a subject of its own.
    unique: bool = False

    def predicates(self) -> set[str]:
        return {TYPE, *(f.predicate for f in self.fields), *(x.predicate for x in self.links)}

    def quads(self, graph: str | None = None) -> list[tuple[str, Column]]:
        """(predicate, quad) of every triple a row gives."""
        subject = template(self.subject)
        made = [(TYPE, quad(subject, TYPE, F.lit(c), "iri", graph=graph)) for c in self.classes]
        for f in self.fields:
            value = quoted(f.column)
            if f.values is not None:
                value = F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(f.values.items())]), value.cast("string"))
            made.append((f.predicate, quad(subject, f.predicate, lexical(value, f.datatype), "literal", f.datatype, f.lang, graph)))
        return made + [(x.predicate, quad(subject, x.predicate, template(x.target), "iri", graph=graph)) for x in self.links]


def lexical(col: Column, datatype: str | None) -> Column:
    """Lexical form of a value; decimals never in exponent notation."""
    match (datatype or "").rsplit("#", 1)[-1]:
        case "decimal":
            return plain_number(col)
        case "integer":
            return col.cast("bigint").cast("string")
        case "dateTime":
            return iso_time(col)
        case "date":
            return col.cast("date").cast("string")
        case "boolean":
            return col.cast("boolean").cast("string")
    return col.cast("string")


_QUADS = "array<struct<" + ",".join(f"{c}:string" for c in QUAD_COLUMNS) + ">>"


def quad(subject: Column, predicate: Column | str, obj: Column, kind: Column | str = "literal",
         datatype: Column | str | None = None, lang: Column | str | None = None,
         graph: Column | str | None = None) -> Column:
    """A quad as a struct, for ``explode(array(...))``."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    values = (subject, predicate, obj, kind, datatype, lang, graph)
    return F.struct(*[as_col(v).alias(n) for v, n in zip(values, QUAD_COLUMNS)])


def explode_quads(df: DataFrame, quads: Sequence[Column], keep: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """One row per non-null quad of each input row; ``more`` are arrays of quads, for repeated values."""
    if more:
        empty = F.array().cast(_QUADS)
        every = F.concat(F.array(*quads), *[F.coalesce(m, empty) for m in more])
        return df.select(*keep, F.inline(every)).filter("subject IS NOT NULL AND object IS NOT NULL")
    if len(quads) == 1:
        # Without a generator Catalyst sees through to the columns: constant
        # predicates fold and filters reach the scan.
        rows = df.select(*keep, quads[0].alias("_q")).select(*keep, "_q.*")
        return rows.filter("subject IS NOT NULL AND object IS NOT NULL")
    if not quads:
        empty = [F.lit(None).cast("string").alias(c) for c in QUAD_COLUMNS]
        return df.limit(0).select(*keep, *empty)
    # Quads are made in a projection of their own: together with the generator they are more code than is compiled.
    names = [f"_q{i}" for i in range(len(quads))]
    made = df.select(*keep, *[q.alias(n) for q, n in zip(quads, names, strict=True)])
    return made.select(*keep, F.inline(F.array(*names))).filter("subject IS NOT NULL AND object IS NOT NULL")


def rows_to_triples(df: DataFrame, mapping: RowMapping, graph: str | None = None,
                    predicates: Sequence[str] | None = None) -> DataFrame:
    """A class triple per row and one triple per non-null cell.

    ``predicates`` limits the output before rows are exploded, so a plan that
    needs two predicates reads two columns.
    """
    return explode_quads(df, [q for p, q in mapping.quads(graph) if predicates is None or p in predicates])


def merge_quads(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Set union: a quad already present is not added again."""
    return deal(existing.unionByName(new), *QUAD_COLUMNS).dropDuplicates(QUAD_COLUMNS)


def append_quads(new: DataFrame, path: str) -> DataFrame:
    """Add the quads of ``new`` that are not stored yet; returns the count per graph.

    Stored by predicate, so that a pattern reads only its own files; so does this: the new quads are compared
    with the folders of their own predicates. ``new`` is read twice and must give the same rows.
    """
    spark = new.sparkSession
    # As many names as folders.
    own = {r["predicate"]: r["count"] for r in new.groupBy("predicate").count().collect()}
    total, offered = sum(own.values()), new.select(*QUAD_COLUMNS, F.lit(False).alias("_stored"))
    try:
        stored = read_quads(spark, path).filter(F.col("predicate").isin(list(own)))
        total += stored.count()
        offered = offered.unionByName(stored.withColumn("_stored", F.lit(True)))
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    # One shuffle drops repeats and what is stored; nulls meet nulls.
    fresh = (deal(offered, *QUAD_COLUMNS, total=total).groupBy(*QUAD_COLUMNS).agg(F.max("_stored").alias("_stored"))
             .filter("NOT _stored").drop("_stored"))
    # The new rows are fixed before the table they were compared with changes.
    fresh = materialise(fresh, "new-quads")
    write_quads(fresh, path, "append")
    return fresh.groupBy("graph").agg(F.count("*").alias("inserted"))


def write_quads(df: DataFrame, path: str, mode: str = "error") -> None:
    # Each task sorts its rows by predicate.
    deal(df.select(*QUAD_COLUMNS), *QUAD_COLUMNS).write.mode(mode).partitionBy("predicate").parquet(path)


def read_quads(spark, path: str) -> DataFrame:
    return spark.read.schema(vocab.QUAD_DDL).parquet(path).select(*QUAD_COLUMNS)


def property_table(quads: QuadSource, class_iri: str, predicates: Mapping[str, str],
                   by_graph: bool = False) -> DataFrame:
    """Wide rows of a class: one column per listed predicate (smallest value if several).

    One pass and one shuffle: class membership is one more conditional
    aggregate beside the columns.
    """
    keys = ["graph", "subject"] if by_graph else ["subject"]
    p, o = F.col("predicate"), F.col("object")
    member = (p == TYPE) & (o == class_iri)
    read = of_predicates(quads, [TYPE, *predicates.values()]).filter(member | p.isin(list(predicates.values())))
    # Smallest texts are found by a sort.
    return (deal(read.select(*keys, "predicate", "object"), *keys)
            .groupBy(*keys)
            .agg(F.max(member).alias("_member"),
                 *[F.min(F.when(p == iri, o)).alias(name) for name, iri in predicates.items()])
            .filter("_member").drop("_member"))


class mapped:  # noqa: N801 - reads as a function of predicates
    """Tables as quads without storing them: a pattern on one predicate reads one column."""

    def __init__(self, tables: Mapping[str, DataFrame], mappings: Mapping[str, RowMapping], graphs: Mapping[str, str]):
        self.tables, self.mappings, self.graphs = tables, mappings, graphs

    def __call__(self, predicates: Sequence[str] | None) -> DataFrame:
        able = [n for n, m in self.mappings.items() if predicates is None or set(predicates) & m.predicates()]
        return reduce(DataFrame.unionByName, [
            rows_to_triples(self.tables[n], self.mappings[n], self.graphs.get(n), predicates) for n in able or list(self.mappings)[:1]])

    def repeats(self, predicates: Sequence[str] | None) -> bool:
        """Whether a triple with one of these predicates may come twice: from rows of one subject, or from two tables, say into two graphs."""
        touching = [m for m in self.mappings.values() if predicates is None or set(predicates) & m.predicates()]
        starts = [m.subject.partition("{")[0] for m in touching]
        meet = any(a.startswith(b) for i, a in enumerate(starts) for k, b in enumerate(starts) if i != k)
        return meet or not all(m.unique for m in touching)

    def star(self, predicates: Sequence[str]) -> DataFrame | None:
        """The quads of one subject with each of these predicates side by side, as columns ``q0``, ``q1``, ...

        None where a row does not tell all of a subject: rows must have subjects
        of their own, no two tables may share a subject, and each predicate may
        stand for one triple of a row only.
        """
        touching = [n for n, m in self.mappings.items() if set(predicates) & m.predicates()]
        starts = [self.mappings[n].subject.partition("{")[0] for n in touching]
        apart = all(not a.startswith(b) for i, a in enumerate(starts) for k, b in enumerate(starts) if i != k)
        able = [n for n in touching if set(predicates) <= self.mappings[n].predicates()]
        once = all(self.mappings[n].unique and [p for p, _ in self.mappings[n].quads()].count(wanted) == 1 for n in able for wanted in predicates)
        if not able or not apart or not once:
            return None
        parts = []
        for n in able:
            made = dict(self.mappings[n].quads(self.graphs.get(n)))
            parts.append(self.tables[n].select(*[made[p].alias(f"q{i}") for i, p in enumerate(predicates)]))
        return reduce(DataFrame.unionByName, parts)


def construct(bindings: DataFrame, templates: Sequence[tuple], graph: str | None = None) -> DataFrame:
    """Triples from bindings. A template is (s, p, o) or (s, p, o, kind, datatype);
    parts starting with ``?`` name binding columns."""
    part = lambda v: quoted(v[1:]) if v.startswith("?") else F.lit(v)
    quads = [quad(part(s), part(p), part(o).cast("string"), *rest, graph=graph) if rest
             else quad(part(s), part(p), part(o).cast("string"), "iri", graph=graph)
             for s, p, o, *rest in templates]
    return explode_quads(bindings, quads).distinct()


def list_graphs(quads: DataFrame) -> DataFrame:
    return quads.select("graph").distinct()


def graph_counts(quads: DataFrame) -> DataFrame:
    """Triples per named graph."""
    return quads.groupBy("graph").agg(F.count("*").alias("triples"))


def graph_exists(quads: DataFrame, graph: str) -> bool:
    return not quads.filter(F.col("graph") == graph).limit(1).isEmpty()


def graph_type(col: Column) -> Column:
    """Type segment of ``{scheme}://{tenant}/{type}/…``."""
    return F.split_part(col, F.lit("/"), F.lit(4))


def graph_tenant(col: Column) -> Column:
    return F.split_part(col, F.lit("/"), F.lit(3))


def drop_graph(quads: DataFrame, graph: str) -> DataFrame:
    """The table without one graph; quads outside any graph stay."""
    return quads.filter(~F.col("graph").eqNullSafe(F.lit(graph)))


def drop_stored_graph(spark, path: str, graph: str) -> None:
    """Removes a graph from a stored quad table; other predicates' files are not touched.

    Partitions that keep quads are rewritten through the shared folder with
    dynamic overwrite; those left empty are deleted.
    """
    # One row per predicate of the graph, with its folder.
    whole = spark.read.schema(vocab.QUAD_DDL).parquet(path)
    folder = F.regexp_extract("_metadata.file_path", "^(.*)/[^/]+$", 1).alias("_dir")
    folders = {r["predicate"]: r["_dir"] for r in whole.select("predicate", "graph", folder).filter(F.col("graph") == graph)
               .select("predicate", "_dir").distinct().collect()}
    touched = sorted(folders)
    stored = whole.filter(F.col("predicate").isin(touched))
    kept = materialise(drop_graph(stored.select(*QUAD_COLUMNS), graph), "kept")
    alive = {r["predicate"] for r in kept.select("predicate").distinct().collect()}
    if alive:
        (deal(kept, *QUAD_COLUMNS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("predicate").parquet(path))
    for predicate in set(touched) - alive:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folders[predicate]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    # Spark remembers file lists.
    spark.catalog.refreshByPath(path)


def upsert_nodes(nodes: DataFrame, key: str = "iri", order: str = "seq") -> DataFrame:
    """Merge versions of a node: the latest non-null value of each property wins."""
    properties = [c for c in nodes.columns if c not in (key, order)]
    return nodes.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in properties])


def upsert_property_maps(nodes: DataFrame, key: str = "iri", properties: str = "properties",
                         order: str = "seq") -> DataFrame:
    """As ``upsert_nodes`` for nodes that carry a map of properties.

    Values are merged per (node, property) first, so a node with very many
    versions is reduced on the map side; only one value per property remains
    when the map is put together again.
    """
    latest = (nodes.select(key, order, F.explode(properties).alias("_k", "_v")).filter("_v IS NOT NULL")
              .groupBy(key, "_k").agg(F.max_by("_v", order).alias("_v")))
    maps = latest.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(properties))
    empty = F.create_map().cast(nodes.schema[properties].dataType)
    return (nodes.select(key).distinct().join(maps, key, "left")
            .withColumn(properties, F.coalesce(properties, empty)))


def merge_edges(edges: DataFrame, nodes: DataFrame, order: str = "seq", key: str = "iri") -> DataFrame:
    """One edge per (from, type, to), only where both ends exist; last properties win."""
    ends = nodes.select(F.col(key).alias("_end")).distinct()
    properties = [c for c in edges.columns if c not in ("from_iri", "edge_type", "to_iri", order)]
    latest = edges.groupBy("from_iri", "edge_type", "to_iri").agg(
        *([F.max_by(F.struct(*properties), order).alias("_p")] if properties else []),
        F.max(order).alias(order))
    latest = (latest.join(ends, latest["from_iri"] == ends["_end"], "left_semi")
              .join(ends, latest["to_iri"] == ends["_end"], "left_semi"))
    return latest.select("from_iri", "edge_type", "to_iri", *[f"_p.{c}" for c in properties], order)


def align_predicates(quads: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rewrite predicates by local name; flag those whose mapping is quarantined.

    ``mapping``: ``source_field``, ``target_property``, ``accepted``. Result is
    the quads with ``quarantined``; kept rows are ``NOT quarantined``. Accepted
    rows are looked up by local name, quarantined ones by the full predicate.
    """
    accepted = (mapping.filter("accepted").groupBy(F.col("source_field").alias("_local"))
                .agg(F.min("target_property").alias("_target")))
    held = (mapping.filter("NOT accepted").select(F.col("source_field").alias("predicate"),
                                                  F.lit(True).alias("_held")).distinct())
    return (quads.withColumn("_local", local_name(F.col("predicate")))
            .join(accepted, "_local", "left").join(held, "predicate", "left")
            .select("subject", F.coalesce("_target", "predicate").alias("predicate"), *QUAD_COLUMNS[2:],
                    (F.col("_target").isNull() & F.coalesce("_held", F.lit(False))).alias("quarantined")))


def exact_matches(entities: DataFrame, known: DataFrame, namespace: str = vocab.ONTOLOGY) -> DataFrame:
    """``skos:exactMatch`` triples: the explicit class, else the known table by name.

    ``entities``: ``name``, nullable ``explicit_class``; ``known``: ``name``,
    ``iri``. A name equal in case is preferred to one equal without case.
    """
    best = known.select(F.lower("name").alias("_l"), F.col("name").alias("_name"), "iri")
    by_exact = best.groupBy("_name").agg(F.min("iri").alias("_exact"))
    by_lower = best.groupBy("_l").agg(F.min("iri").alias("_loose"))
    e = entities.withColumn("_name", F.col("name")).withColumn("_l", F.lower("name"))
    found = (e.join(by_exact, "_name", "left").join(by_lower, "_l", "left")
             .withColumn("_iri", F.coalesce("explicit_class", "_exact", "_loose")))
    return explode_quads(found, [quad(F.concat(F.lit(namespace), "name"), vocab.EXACT_MATCH, F.col("_iri"), "iri")])


def module_counts(quads: DataFrame) -> DataFrame:
    """Classes, properties and shapes per graph."""
    o = F.col("object")
    properties = [vocab.OWL + "ObjectProperty", vocab.OWL + "DatatypeProperty", vocab.RDF + "Property"]
    return (quads.filter(F.col("predicate") == TYPE).groupBy("graph").agg(
        F.count_if(o.isin(vocab.OWL + "Class", vocab.RDFS + "Class")).alias("classes"),
        F.count_if(o.isin(properties)).alias("properties"),
        F.count_if(o == vocab.SH + "NodeShape").alias("shapes")))
