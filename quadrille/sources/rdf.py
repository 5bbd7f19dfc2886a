"""Semi-structured sources to quads, and quads to lines of text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import vocab
from quadrille.functions.columns import plain_number
from quadrille.functions.rdf_text import jsonld_triples, rdfxml_triples
from quadrille.operators.triples import explode_quads, quad
from quadrille.vocab import FHIR, QUAD_COLUMNS, QUAD_DDL, TYPE, XSD

FHIR_BUNDLE = """entry array<struct<resource:struct<resourceType:string,id:string,birthDate:string,
    name:array<struct<given:array<string>,family:string>>,status:string,subject:struct<reference:string>,
    valueQuantity:struct<value:string>>>>"""


def fhir_to_triples(df: DataFrame, column: str = "value", base: str = vocab.ONTOLOGY, graph: str | None = None) -> DataFrame:
    """Bundles of FHIR resources (JSON text, one bundle per row) to quads.

    Patients give type, birth date and one name per entry; observations type,
    status, subject and value; other resources with an id their type only.
    """
    bundle = F.from_json(F.col(column), FHIR_BUNDLE)
    # A missing or empty entry list yields no rows.
    r = df.select(F.explode(bundle["entry"]).alias("e")).select("e.resource.*").filter("resourceType IS NOT NULL")
    kind, rid = F.col("resourceType"), F.col("id")
    subject = F.concat(F.lit(base), kind, F.lit("/"), rid)
    patient, observation = kind == "Patient", kind == "Observation"
    full = lambda n: F.trim(F.concat(F.coalesce(F.array_join(n["given"], " "), F.lit("")), F.lit(" "),
                                     F.coalesce(n["family"], F.lit(""))))
    names = F.when(patient, F.transform("name", lambda n: quad(subject, FHIR + "name", full(n), graph=graph)))
    # Names go through the same pass, so that bundles are parsed once.
    return explode_quads(r, [
        quad(subject, TYPE, F.concat(F.lit(FHIR), kind), "iri", graph=graph),
        quad(subject, FHIR + "birthDate", F.when(patient, F.col("birthDate")), "literal", XSD + "date", graph=graph),
        quad(subject, FHIR + "status", F.when(observation, F.col("status")), graph=graph),
        quad(subject, FHIR + "subject", F.when(observation & (F.col("subject.reference") != ""), F.concat(
            F.lit(base), F.replace(F.col("subject.reference"), F.lit("#"), F.lit("")))), "iri", graph=graph),
        quad(subject, FHIR + "valueQuantity", F.when(observation, plain_decimal(plain_number(F.col("valueQuantity.value")))), "literal",
             XSD + "decimal", graph=graph)], more=[names]).distinct()


def unreadable_bundles(df: DataFrame, column: str = "value") -> DataFrame:
    """Bundles that give nothing because they cannot be read: (value, fault).

    ``no json``: not JSON; ``no bundle``: JSON whose ``entry`` is missing or is not a list. A
    list without entries, or with resources of other kinds, is no fault.
    """
    text = F.col(column)
    entry = F.get_json_object(text, "$.entry")
    fault = (F.when(F.get_json_object(text, "$").isNull(), "no json")
             .when(entry.isNull() | ~F.trim(entry).startswith("["), "no bundle"))
    return df.select(text.alias("value"), fault.alias("fault")).filter("fault IS NOT NULL")


def plain_decimal(col: Column) -> Column:
    """Decimal text without trailing zeros."""
    text = col.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def _per_document(df: DataFrame, column: str, key: str | None, parse, graph: str | None) -> DataFrame:
    """One document per row through a parser that returns (s, p, o, kind, datatype, lang)."""
    source = df.select(F.col(column).alias("text"), (F.col(key).cast("string") if key else F.sha2(F.col(column), 256)).alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*triple, graph) for text, name in zip(batch["text"], batch["key"]) if text for triple in parse(text, name)]
            yield pd.DataFrame(rows, columns=QUAD_COLUMNS, dtype=object)

    return source.mapInPandas(run, QUAD_DDL)


def jsonld_to_triples(df: DataFrame, column: str = "value", key: str | None = None, graph: str | None = None) -> DataFrame:
    """JSON-LD documents, one per row, to quads."""
    return _per_document(df, column, key, jsonld_triples, graph)


def rdfxml_to_triples(df: DataFrame, column: str = "value", key: str | None = None, graph: str | None = None) -> DataFrame:
    """RDF/XML documents, one per row, to quads."""
    return _per_document(df, column, key, rdfxml_triples, graph)


def cim_xml_to_triples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """CIM model files (RDF/XML), one file per row, to quads."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return rdfxml_to_triples(files, "value", "file", graph)


def _escape(col: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        col = F.replace(col, F.lit(raw), F.lit(escaped))
    return col


def _code_points(part: Column, mark: str, digits: int) -> Column:
    """Replaces ``mark`` and so many hexadecimal digits by the character they number; surrogates stay as they are."""
    def one(piece: Column) -> Column:
        code = F.substring(piece, 1, digits)
        valid = code.rlike(f"^[0-9A-Fa-f]{{{digits}}}$") & ~code.rlike("^(0000)?[Dd][89A-Fa-f]") & (F.lpad(code, 8, "0") <= "0010ffff")
        char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, F.substr(piece, F.lit(digits + 1)))).otherwise(F.concat(F.lit(mark), piece))

    pieces = F.split(part, mark.replace("\\", "\\\\"))
    return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), one), ""))


def _unescape(col: Column) -> Column:
    """Escapes of the line format, read from left to right.

    Cutting at doubled backslashes first leaves pieces in which every backslash begins an escape.
    """
    def plain(part: Column) -> Column:
        part = _code_points(_code_points(part, "\\U", 8), "\\u", 4)
        for escaped, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
            part = F.replace(part, F.lit(escaped), F.lit(raw))
        return part

    return F.when(col.contains("\\"), F.array_join(F.transform(F.split(col, r"\\\\"), plain), "\\")).otherwise(col)


def render_quads(df: DataFrame) -> DataFrame:
    """One N-Quads ``line`` per quad; quads without a graph are N-Triples lines."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    suffix = (F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">")))
              .when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(""))
    literal = F.concat(F.lit('"'), _escape(F.col("object")), F.lit('"'), suffix)
    obj = F.when(F.col("object_kind") == "literal", literal).otherwise(node("object"))
    graph = F.when(F.col("graph").isNotNull(), F.concat(F.lit("<"), "graph", F.lit(">")))
    return df.select(F.concat_ws(" ", node("subject"), node("predicate"), obj, graph, F.lit(".")).alias("line"))


def render_jsonld(df: DataFrame) -> DataFrame:
    """One JSON-LD node object per quad, as ``line``.

    Objects with the same ``@id`` describe one node, so a subject's quads need
    not be brought together.
    """
    string = (F.col("object_kind") == "literal")
    value = F.to_json(F.struct(
        F.when(~string, F.col("object")).alias("@id"), F.when(string, F.col("object")).alias("@value"),
        F.when(string, F.col("datatype")).alias("@type"), F.when(string, F.col("lang")).alias("@language")))
    name = lambda c: F.to_json(F.array(F.col(c)))
    inner = lambda j: F.substr(j, F.lit(2), F.length(j) - 2)
    node = F.concat(F.lit('{"@id":'), inner(name("subject")), F.lit(","), inner(name("predicate")), F.lit(":"), value, F.lit("}"))
    line = F.when(F.col("graph").isNull(), node).otherwise(
        F.concat(F.lit('{"@id":'), inner(name("graph")), F.lit(',"@graph":['), node, F.lit("]}")))
    return df.select(line.alias("line"))


NODE = r"<[^>]*>|_:\S+"
HEAD = rf"^\s*({NODE})\s+<([^>]*)>\s+"
END = rf"\s*({NODE})?\s*\.\s*(?:#.*)?$"
LITERAL_END = r"^(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?" + END
NODE_END = rf"^({NODE})" + END


def _cut_lines(df: DataFrame, column: str) -> DataFrame:
    """Subject, predicate and rest of each line, a literal's body and tail, and whether the line can be read.

    A literal ends at the first quote that no backslash escapes: with doubled
    backslashes and escaped quotes blotted out, at the first quote.
    """
    line = F.col(column)
    rest = F.substr(line, F.length(F.regexp_extract(line, HEAD, 0)) + 1)
    blotted = F.replace(F.replace(rest, F.lit("\\\\"), F.lit("__")), F.lit('\\"'), F.lit("__"))
    end = F.locate('"', blotted, 2)
    cut = df.select(line.alias("_line"), F.regexp_extract(line, HEAD, 1).alias("_s"), F.regexp_extract(line, HEAD, 2).alias("predicate"), rest.alias("_rest"),
                    F.when(rest.startswith('"') & (end > 0), end).alias("_end"))
    literal = F.col("_end").isNotNull()
    tail = F.when(literal, F.substr(F.col("_rest"), F.col("_end") + 1)).alias("_tail")
    cut = cut.select("*", tail)
    readable = (F.col("_s") != "") & F.when(literal, F.col("_tail").rlike(LITERAL_END)).otherwise(F.col("_rest").rlike(NODE_END))
    return cut.withColumn("_readable", F.coalesce(readable, F.lit(False)))


def parse_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """N-Triples or N-Quads lines to quads; comments and blank lines are skipped, ``unreadable_lines`` gives the others without a quad."""
    cut = _cut_lines(df, column).filter("_readable")
    literal, tail, whole = F.col("_end").isNotNull(), F.col("_tail"), F.col("_rest")
    body = F.substr(whole, F.lit(2), F.col("_end") - 2)
    node = F.regexp_extract(whole, NODE_END, 1)
    graph = F.when(literal, F.regexp_extract(tail, LITERAL_END, 3)).otherwise(F.regexp_extract(whole, NODE_END, 2))
    text = lambda c: F.when(c != "", c)
    bare = lambda c: F.when(c.startswith("<"), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)
    kind = F.when(literal, "literal").when(node.startswith("<"), "iri").otherwise("bnode")
    return cut.select(
        bare(F.col("_s")).alias("subject"), "predicate", F.when(literal, _unescape(body)).otherwise(bare(node)).alias("object"),
        kind.alias("object_kind"), F.when(literal, text(F.regexp_extract(tail, LITERAL_END, 1))).alias("datatype"),
        F.when(literal, text(F.regexp_extract(tail, LITERAL_END, 2))).alias("lang"), text(bare(graph)).alias("graph"))


def unreadable_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are neither blank nor a comment and give no quad, as ``line``."""
    return _cut_lines(df, column).filter(~F.col("_readable") & ~F.col("_line").rlike(r"^\s*(#|$)")).select(F.col("_line").alias("line"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def write_ntriples(df: DataFrame, path: str, mode: str = "error") -> None:
    render_quads(df).write.mode(mode).text(path)
