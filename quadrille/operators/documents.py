"""Documents to chunks, extractions, vertices and triples.

Documents are rows throughout. Parsing, chunking and rule matching read whole
texts in Arrow batches; everything after them is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille import vocab
from quadrille.functions.columns import plain_number, short_class
from quadrille.functions.text import chunk_spans, parse_html
from quadrille.operators.triples import explode_quads, quad
from quadrille.session import ROWS_TO_QUADS, deal, materialise
from quadrille.vocab import TYPE

SECTIONS = "array<struct<heading:string,level:int,char_start:int,char_end:int>>"
TABLES = ("array<struct<caption:string,cells:array<struct<row:int,col:int,text:string,row_span:int,col_span:int>>,"
          "char_start:int,char_end:int>>")
EXTRACTION = ("extraction_type string, text_span string, ontology_class string, attributes map<string,string>, "
              "char_interval struct<start:int,end:int>, confidence_score double, model_id string, chunk_index int")

# File suffixes and the media types they mean.
MIME = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".html": "text/html",
    ".htm": "text/html",
}

@dataclass(frozen=True)
class KnownClass:
    """What the caller's graph calls a class: its vertex type and its IRI, either of them if known."""

    vertex_type: str | None = None
    iri: str | None = None


Classes = Mapping[str, KnownClass]


@dataclass(frozen=True)
class Rule:
    """A pattern that yields extractions; named groups become attributes."""

    extraction_type: str
    ontology_class: str
    pattern: str
    attributes: Mapping[str, str] = field(default_factory=dict)
    confidence: float | None = None


# Code formats: ISO 17442 identifiers, bank codes, amounts with currency, dates.
RULES = (
    Rule("LegalEntityIdentifier", "fibo:LegalEntity", r"(?<![A-Z0-9])[A-Z0-9]{18}[0-9]{2}(?![A-Z0-9])", {"scheme": "lei"}),
    Rule("BankIdentifier", "fibo:CommercialBank", r"(?<![A-Z0-9])[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?(?![A-Z0-9])",
         {"scheme": "bic"}, 0.8),
    Rule("MonetaryAmount", "fibo:MonetaryAmount",
         r"(?P<currency>EUR|USD|GBP|CHF|JPY)\s?(?P<amount>[0-9][0-9,]*(?:\.[0-9]+)?)"),
    Rule("Date", "Date", r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])", {}, 0.9),
)


def _schema(fields: Sequence[T.StructField], ddl: str) -> T.StructType:
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


def mime_type(path: Column) -> Column:
    result = F.lit("application/octet-stream")
    for suffix, mime in MIME.items():
        result = F.when(F.lower(path).endswith(suffix), mime).otherwise(result)
    return result


# Characters of text that a task works on at once.
SLICE_CHARS = 1 << 20


def _slices(batches: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """Rows in slices of at most SLICE_CHARS characters of ``text``, one row at least: what is made of them can be many times as large."""
    for batch in batches:
        begin = size = 0
        for at, value in enumerate(batch[text]):
            chars = len(value or "")
            if at > begin and size + chars > SLICE_CHARS:
                yield batch.iloc[begin:at]
                begin, size = at, 0
            size += chars
        if begin < len(batch):
            yield batch.iloc[begin:]


def parse_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """HTML column to ``text``, ``sections``, ``tables``, ``word_count``; other columns stay."""
    keep = [c for c in df.columns if c != html]
    schema = _schema([df.schema[c] for c in keep], f"text string, sections {SECTIONS}, tables {TABLES}, word_count int")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, html):
            parsed = [parse_html(h or "") for h in batch[html]]
            out = batch[keep].copy()
            for name in ("text", "sections", "tables"):
                out[name] = [p[name] for p in parsed]
            out["word_count"] = [len(p["text"].split()) for p in parsed]
            yield out

    return df.mapInPandas(parse, schema)


def chunk(df: DataFrame, key: str, text: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, text, char_start, char_end, token_count) of every document."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")
    schema = _schema([df.schema[key]], "chunk_index int, text string, char_start int, char_end int, token_count int")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, text):
            rows = [(k, i, body[a:b], a, b, n) for k, body in zip(batch[key], batch[text]) if body
                    for i, (a, b, n) in enumerate(chunk_spans(body, size, overlap))]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, text).mapInPandas(split, schema)


Extractor = Callable[[str], Sequence[Mapping[str, object]]]


def _rule_extractor(rules: Sequence[Rule]) -> Extractor:
    compiled = [(r, re.compile(r.pattern)) for r in rules]

    def run(text: str) -> list[dict]:
        found = []
        for rule, pattern in compiled:
            for m in pattern.finditer(text):
                found.append({"extraction_type": rule.extraction_type, "text_span": m.group(0),
                              "ontology_class": rule.ontology_class,
                              "attributes": {**rule.attributes, **{k: v for k, v in m.groupdict().items() if v is not None}},
                              "char_interval": {"start": m.start(), "end": m.end()}, "confidence": rule.confidence})
        return found

    return run


def extract(chunks: DataFrame, key: str, rules: Sequence[Rule] = RULES, extractor: Extractor | None = None,
            model_id: str = "rules", mark_chunks: bool = False) -> DataFrame:
    """Extractions of every chunk, by rules or by the caller's own function.

    A missing confidence counts as 1.0; a confidence of zero stays zero. Spans
    are relative to the chunk; ``rebase`` moves them to the document. With ``mark_chunks``
    each chunk gives one more row, without a type, so that chunks can be counted in the same pass.
    """
    run = extractor or _rule_extractor(rules)
    schema = _schema([chunks.schema[key]], "_offset int, " + EXTRACTION)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, "text"):
            rows = []
            for k, index, offset, text in zip(batch[key], batch["chunk_index"], batch["char_start"], batch["text"]):
                if mark_chunks:
                    rows.append((k, offset, None, None, None, None, None, None, None, index))
                for x in run(text):
                    attributes = {a: None if v is None else str(v) for a, v in dict(x.get("attributes") or {}).items()}
                    cls = attributes.pop("class", None) or x.get("ontology_class") or x["extraction_type"]
                    score = x.get("confidence")
                    rows.append((k, offset, x["extraction_type"], x["text_span"], cls, attributes, x.get("char_interval"),
                                 1.0 if score is None else float(score), model_id, index))
            yield pd.DataFrame(rows, columns=schema.names)

    return chunks.select(key, "chunk_index", "char_start", "text").mapInPandas(find, schema)


def rebase(extractions: DataFrame) -> DataFrame:
    """Chunk-relative spans to document spans; an absent span stays absent."""
    moved = F.struct((F.col("char_interval.start") + F.col("_offset")).alias("start"),
                     (F.col("char_interval.end") + F.col("_offset")).alias("end"))
    return extractions.withColumn("char_interval", F.when(F.col("char_interval").isNotNull(), moved)).drop("_offset")


def distinct_mentions(extractions: DataFrame, key: str) -> DataFrame:
    """Each mention once: chunks that overlap find what lies in both. The first chunk's finding stays.

    Ungrounded extractions have no place and all stay.
    """
    names = [key, "extraction_type", "ontology_class", "char_interval", "text_span"]
    rest = [c for c in extractions.columns if c not in names]
    # What has no place gets a number of its own, so that one pass over the texts serves both.
    own = F.when(F.col("char_interval").isNull(), F.monotonically_increasing_id())
    once = extractions.withColumn("_own", own).groupBy(*names, "_own").agg(F.min_by(F.struct(*rest), "chunk_index").alias("_rest"))
    return once.select(*names, "_rest.*").select(*extractions.columns)


def confidence_gate(extractions: DataFrame, confidence_threshold: float = 0.5) -> DataFrame:
    """Adds ``decision`` (PASS or QUARANTINE) and ``reason``, rules in order."""
    if not 0.0 <= confidence_threshold <= 1.0:
        raise ValueError(f"confidence_threshold must be in [0, 1], got {confidence_threshold}")
    span, score = F.col("char_interval"), F.col("confidence_score")
    start, end = F.col("char_interval.start"), F.col("char_interval.end")
    reason = (F.when(span.isNull(), F.lit("ungrounded: no text span"))
              .when((start < 0) | (end <= start), F.format_string("invalid char_interval (%d, %d)", start, end))
              .when(score < confidence_threshold,
                    F.format_string(f"low confidence: %.3f < threshold {confidence_threshold:.3f}", score)))
    return extractions.withColumn("reason", reason).withColumn(
        "decision", F.when(F.col("reason").isNull(), "PASS").otherwise("QUARANTINE"))


def passed(gated: DataFrame) -> DataFrame:
    return gated.filter("decision = 'PASS'").drop("decision", "reason")


def quarantined(gated: DataFrame) -> DataFrame:
    return gated.filter("decision = 'QUARANTINE'")


def entity_iri(ontology_class: Column, text: Column, scheme: str = vocab.SCHEME, length: int = 8) -> Column:
    """``{scheme}://entity/{class}/{slug}-{hash}``; ``length`` digits of the hash."""
    slug = F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("-"))
    digest = F.sha2(F.concat(ontology_class, F.lit(":"), text), 256)
    return F.concat(F.lit(f"{scheme}://entity/"), short_class(ontology_class), F.lit("/"), slug, F.lit("-"),
                    F.substring(digest, 1, length))


def known_class(ontology_class: Column, classes: Classes) -> Column:
    """The entry of a class as a struct, by its name or else by its short name; null without one."""
    entries = dict(classes)
    for name, entry in classes.items():
        entries.setdefault(re.split("[:/#]", name)[-1], entry)
    if not entries:
        return F.lit(None).cast("struct<vertex_type:string,iri:string>")
    struct = lambda c: F.struct(F.lit(c.vertex_type).cast("string").alias("vertex_type"), F.lit(c.iri).cast("string").alias("iri"))
    table = F.create_map(*chain.from_iterable((F.lit(name), struct(c)) for name, c in entries.items()))
    return F.coalesce(F.element_at(table, ontology_class), F.element_at(table, short_class(ontology_class)))


def vertex_type(ontology_class: Column, classes: Classes) -> Column:
    """The known vertex type, else the short name of the class."""
    short = short_class(ontology_class)
    return F.coalesce(known_class(ontology_class, classes)["vertex_type"], F.when(short != "", short), F.lit("Entity"))


def class_iri(ontology_class: Column, classes: Classes, base: str = vocab.ONTOLOGY) -> Column:
    """The known IRI, else the class itself if it is one, else the short name below ``base``."""
    own = F.when(ontology_class.startswith("http"), ontology_class).otherwise(F.concat(F.lit(base), short_class(ontology_class)))
    return F.coalesce(known_class(ontology_class, classes)["iri"], own)


def vertices(extractions: DataFrame, key: str, classes: Classes, scheme: str = vocab.SCHEME, length: int = 8,
             embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """One vertex per IRI; of several extractions the latest in reading order describes it.

    Attributes of earlier mentions stay unless a later one sets them anew.
    Every choice is a ``max_by`` with map-side combine: an entity named in a
    third of all documents is one row per task and attribute before the
    shuffle. ``embed`` makes a vector column of the label, for example a pandas UDF over a model.
    """
    iri = entity_iri(F.col("ontology_class"), F.col("text_span"), scheme, length)
    order = F.struct(F.col(key), F.col("char_interval.start").alias("at"), F.col("chunk_index").alias("chunk"),
                     F.col("extraction_type").alias("type"))
    described = extractions.select(
        iri.alias("iri"), order.alias("_order"),
        F.struct(vertex_type(F.col("ontology_class"), classes).alias("vertex_type"), "ontology_class", F.col("text_span").alias("label"),
                 "model_id", "confidence_score", F.col("char_interval.start").alias("char_start"), F.col("char_interval.end").alias("char_end"),
                 F.col(key)).alias("_v"),
        F.map_entries(F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())).alias("_a"))
    # One row for the mention (without an attribute) and one per attribute.
    none = F.array(F.lit(None).cast("struct<key:string,value:string>"))
    each = described.select("iri", "_order", "_v", F.explode(F.concat(none, "_a")).alias("_e"))
    mention = F.col("_e").isNull()
    parts = each.groupBy("iri", F.col("_e.key").alias("_key")).agg(
        F.max_by(F.col("_e.value"), "_order").alias("_value"), F.max_by(F.when(mention, F.col("_v")), "_order").alias("_v"),
        F.count_if(mention).alias("_n"))
    attributes = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_key").isNotNull(), F.struct("_key", "_value")))))
    whole = parts.groupBy("iri").agg(F.first("_v", ignorenulls=True).alias("_v"), attributes.alias("attributes"), F.sum("_n").alias("mentions"))
    out = whole.select("iri", "_v.*", "attributes", "mentions")
    return out if embed is None else out.withColumn("embedding", embed(F.col("label")))


def extraction_triples(extractions: DataFrame, job_id: str, source: Column, graph: str, classes: Classes,
                       base: str = vocab.ONTOLOGY, scheme: str = vocab.SCHEME, length: int = 8) -> DataFrame:
    """Entity and provenance triples of grounded extractions; IRIs as in ``vertices``."""
    activity = f"{vocab.RESOURCE}activity/{job_id}"
    grounded = extractions.filter("char_interval IS NOT NULL")
    subject = entity_iri(F.col("ontology_class"), F.col("text_span"), scheme, length)
    decimal, integer = vocab.XSD + "decimal", vocab.XSD + "integer"
    rows = grounded.select(
        subject.alias("s"), class_iri(F.col("ontology_class"), classes, base).alias("cls"), "text_span", source.alias("src"),
        F.col("char_interval.start").cast("string").alias("a"), F.col("char_interval.end").cast("string").alias("b"),
        plain_number(F.col("confidence_score")).alias("score"),
        "attributes")
    # Stored, so that the number of quads is known without reading the texts again.
    rows = materialise(rows, "grounded")
    total = rows.select(F.sum(8 + F.greatest(F.coalesce(F.size("attributes"), F.lit(0)), F.lit(0)))).first()[0] or 0
    rows = deal(rows, *rows.columns[:-1], rows=ROWS_TO_QUADS)
    s = F.col("s")
    attributes = F.transform(F.map_entries("attributes"), lambda e: quad(s, F.concat(F.lit(base), e["key"]), e["value"], graph=graph))
    # Attributes go through the same pass, so that texts are read once.
    made = explode_quads(rows, [
        quad(s, TYPE, F.col("cls"), "iri", graph=graph), quad(s, TYPE, F.lit(vocab.NAMED_INDIVIDUAL), "iri", graph=graph),
        quad(s, vocab.LABEL, F.col("text_span"), graph=graph),
        quad(s, vocab.PROV + "wasGeneratedBy", F.lit(activity), "iri", graph=graph),
        quad(s, vocab.PROV + "wasDerivedFrom", F.col("src"), "iri", graph=graph),
        quad(s, base + "charStart", F.col("a"), "literal", integer, graph=graph),
        quad(s, base + "charEnd", F.col("b"), "literal", integer, graph=graph),
        quad(s, base + "confidenceScore", F.col("score"), "literal", decimal, graph=graph)], more=[attributes])
    return deal(made, *vocab.QUAD_COLUMNS, total=total).distinct()


def run_triples(spark, job_id: str, model_id: str, started: str, graph: str, base: str = vocab.ONTOLOGY) -> DataFrame:
    """Activity and agent of one extraction run."""
    a, g = F.lit(f"{vocab.RESOURCE}activity/{job_id}"), F.lit(f"{vocab.RESOURCE}agent/{model_id}")
    return explode_quads(spark.range(1), [
        quad(a, TYPE, F.lit(vocab.PROV + "Activity"), "iri", graph=graph),
        quad(a, vocab.PROV + "startedAtTime", F.lit(started), "literal", vocab.XSD + "dateTime", graph=graph),
        quad(a, base + "jobId", F.lit(job_id), graph=graph), quad(a, base + "modelId", F.lit(model_id), graph=graph),
        quad(g, TYPE, F.lit(vocab.PROV + "SoftwareAgent"), "iri", graph=graph),
        quad(g, vocab.LABEL, F.lit(model_id), graph=graph),
        quad(a, vocab.PROV + "wasAssociatedWith", g, "iri", graph=graph)])


def run_summary(marked: DataFrame, key: str) -> DataFrame:
    """One row: chunks, extractions, passed, quarantined, entities; from gated extractions with marked chunks, in one pass."""
    iri = entity_iri(F.col("ontology_class"), F.col("text_span"))
    mark = F.col("extraction_type").isNull()
    ok = ~mark & (F.col("decision") == "PASS")
    return marked.agg(F.count_if(mark).alias("chunks"), F.count_if(~mark).alias("extractions"), F.count_if(ok).alias("passed"),
                      F.count_if(~mark & (F.col("decision") != "PASS")).alias("quarantined"), F.count_distinct(F.when(ok, iri)).alias("entities"))


def document_run(df: DataFrame, key: str, classes: Classes, rules: Sequence[Rule] = RULES, html: str | None = None, threshold: float = 0.5,
                 size: int = 512, overlap: int = 50, job_id: str = "job", source: Column | None = None,
                 graph: str = f"{vocab.SCHEME}://default/instance/documents/v1", store: bool = False) -> dict[str, DataFrame]:
    """All steps as lazy results: chunks, gated extractions, vertices and triples.

    Texts are read again for every result that is used. With ``store`` the
    extractions, which are far smaller than the texts, are written once to the
    shared folder and the later results start from them.
    """
    if html is not None:
        df = parse_pages(df.select(key, html), html)
    chunks = chunk(df, key, size=size, overlap=overlap)
    gated = confidence_gate(distinct_mentions(rebase(extract(chunks, key, rules)), key), threshold)
    if store:
        gated = materialise(gated, "extractions")
    kept = passed(gated)
    where = source if source is not None else F.concat(F.lit(vocab.RESOURCE + "document/"), F.col(key).cast("string"))
    return {"chunks": chunks, "gated": gated, "vertices": vertices(kept, key, classes),
            "triples": extraction_triples(kept, job_id, where, graph, classes)}
