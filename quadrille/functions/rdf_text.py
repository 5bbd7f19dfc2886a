"""Readers for one RDF/XML or JSON-LD document; Spark spreads the documents.

Triples are (subject, predicate, object, kind, datatype, lang). Blank nodes are
named after the document and their position, so that a retried task gives the
same names.
"""

from __future__ import annotations

import hashlib
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XML = "{http://www.w3.org/XML/1998/namespace}"


class _Blank:
    def __init__(self, key: str):
        self.prefix, self.n = hashlib.sha256(key.encode()).hexdigest()[:12], 0

    def new(self) -> str:
        self.n += 1
        return f"_:{self.prefix}n{self.n}"

    def named(self, label: str) -> str:
        return f"_:{self.prefix}x{label}"


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def rdfxml_triples(text: str, key: str = "") -> Iterator[tuple]:
    """Typed nodes, property elements and attributes, nested nodes, collections."""
    r = "{" + RDF + "}"
    blank = _Blank(key)

    def resolve(ref: str, base: str) -> str:
        if ref.startswith("#") or ref == "":
            return base + ref
        return ref

    def node(el, base: str, lang: str | None):
        base, lang = el.get(XML + "base", base), el.get(XML + "lang", lang)
        if el.get(r + "about") is not None:
            subject = resolve(el.get(r + "about"), base)
        elif el.get(r + "ID") is not None:
            subject = base + "#" + el.get(r + "ID")
        elif el.get(r + "nodeID") is not None:
            subject = blank.named(el.get(r + "nodeID"))
        else:
            subject = blank.new()
        if el.tag != r + "Description":
            yield "subject", (subject, RDF + "type", _iri(el.tag), "iri", None, None)
        for name, value in el.attrib.items():
            if name == r + "type":
                yield "subject", (subject, RDF + "type", value, "iri", None, None)
            elif not name.startswith((r, XML)):
                yield "subject", (subject, _iri(name), value, "literal", None, lang)
        item = 0
        for child in el:
            predicate = _iri(child.tag)
            if child.tag == r + "li":
                item += 1
                predicate = f"{RDF}_{item}"
            yield from (("inner", t) for t in property_element(subject, predicate, child, base, lang))
        yield "name", subject

    def run(el, base, lang) -> tuple[str, list[tuple]]:
        triples, name = [], ""
        for what, value in node(el, base, lang):
            if what == "name":
                name = value
            else:
                triples.append(value)
        return name, triples

    def property_element(subject, predicate, child, base, lang):
        base, lang = child.get(XML + "base", base), child.get(XML + "lang", lang)
        kind = child.get(r + "parseType")
        if child.get(r + "resource") is not None:
            yield (subject, predicate, resolve(child.get(r + "resource"), base), "iri", None, None)
        elif child.get(r + "nodeID") is not None:
            yield (subject, predicate, blank.named(child.get(r + "nodeID")), "bnode", None, None)
        elif kind == "Resource":
            name = blank.new()
            yield (subject, predicate, name, "bnode", None, None)
            for inner in child:
                yield from property_element(name, _iri(inner.tag), inner, base, lang)
        elif kind == "Collection":
            names = []
            for inner in child:
                name, triples = run(inner, base, lang)
                names.append(name)
                yield from triples
            cells = [blank.new() for _ in names] + [RDF + "nil"]
            term = lambda v: "bnode" if v.startswith("_:") else "iri"
            yield (subject, predicate, cells[0], term(cells[0]), None, None)
            for cell, name, rest in zip(cells, names, cells[1:]):
                yield (cell, RDF + "first", name, term(name), None, None)
                yield (cell, RDF + "rest", rest, term(rest), None, None)
        elif len(child):
            for inner in child:
                name, triples = run(inner, base, lang)
                yield (subject, predicate, name, "bnode" if name.startswith("_:") else "iri", None, None)
                yield from triples
        else:
            datatype = child.get(r + "datatype")
            yield (subject, predicate, child.text or "", "literal", datatype, None if datatype else lang)

    root = ET.fromstring(text)
    base, lang = root.get(XML + "base", ""), root.get(XML + "lang")
    for el in (root if root.tag == r + "RDF" else [root]):
        yield from run(el, base, lang)[1]


class _Context:
    """Prefixes, terms, vocabulary and default language of a JSON-LD context."""

    def __init__(self, parent: "_Context | None" = None):
        self.terms = dict(parent.terms) if parent else {}
        self.vocab = parent.vocab if parent else None
        self.base = parent.base if parent else ""
        self.lang = parent.lang if parent else None

    def extended(self, context) -> "_Context":
        new = _Context(self)
        for part in context if isinstance(context, list) else [context]:
            if part is None:
                new = _Context()
                continue
            if not isinstance(part, dict):
                raise ValueError("remote contexts are not loaded")
            new.vocab, new.base = part.get("@vocab", new.vocab), part.get("@base", new.base)
            new.lang = part.get("@language", new.lang)
            new.terms.update({k: v for k, v in part.items() if not k.startswith("@")})
        return new

    def iri(self, name: str, vocab: bool) -> str | None:
        if name.startswith("_:") or name.startswith("@"):
            return name
        term = self.terms.get(name) if vocab else None
        if isinstance(term, dict):
            term = term.get("@id", name)
        if isinstance(term, str) and term != name:
            return self.iri(term, True)
        if ":" in name:
            prefix, rest = name.split(":", 1)
            space = self.terms.get(prefix)
            if isinstance(space, dict):
                space = space.get("@id")
            if isinstance(space, str) and not rest.startswith("//"):
                return (self.iri(space, True) or space) + rest
            return name
        if vocab:
            return self.vocab + name if self.vocab is not None else None
        return self.base + name


def jsonld_triples(text: str, key: str = "") -> Iterator[tuple]:
    """Contexts, ``@graph``, nested nodes, typed and language values, lists and reverse links."""
    blank = _Blank(key)

    def term(name: str) -> str:
        return "bnode" if name.startswith("_:") else "iri"

    def label(name: str) -> str:
        return blank.named(name[2:]) if name.startswith("_:") else name

    def literal(value, datatype, lang):
        if isinstance(value, bool):
            return ("true" if value else "false"), "literal", datatype or XSD + "boolean", None
        if isinstance(value, int):
            return str(value), "literal", datatype or XSD + "integer", None
        if isinstance(value, float):
            if value.is_integer() and abs(value) < 1e21 and not datatype:
                return str(int(value)), "literal", XSD + "integer", None
            return repr(value), "literal", datatype or XSD + "double", None
        return str(value), "literal", datatype, None if datatype else lang

    def objects(value, ctx: _Context, definition: dict, out: list):
        """(object, kind, datatype, lang) for every value of a property."""
        if value is None:
            return
        if isinstance(value, list):
            if definition.get("@container") == "@list":
                yield make_list(value, ctx, definition, out)
                return
            for v in value:
                yield from objects(v, ctx, definition, out)
        elif isinstance(value, dict):
            if "@value" in value:
                if value["@value"] is not None:
                    t = value.get("@type")
                    yield literal(value["@value"], ctx.iri(t, True) if t else None, value.get("@language"))
            elif "@list" in value:
                yield make_list(value["@list"], ctx, definition, out)
            elif "@set" in value:
                yield from objects(value["@set"], ctx, definition, out)
            elif definition.get("@container") == "@language" and not any(k.startswith("@") for k in value):
                for lang, v in value.items():
                    for one in v if isinstance(v, list) else [v]:
                        yield literal(one, None, lang)
            else:
                name = node(value, ctx, out)
                yield name, term(name), None, None
        else:
            kind = definition.get("@type")
            if kind in ("@id", "@vocab") and isinstance(value, str):
                name = label(ctx.iri(value, kind == "@vocab") or value)
                yield name, term(name), None, None
            else:
                datatype = ctx.iri(kind, True) if kind and not kind.startswith("@") else None
                yield literal(value, datatype, definition.get("@language", ctx.lang))

    def make_list(values, ctx, definition, out):
        plain = {k: v for k, v in definition.items() if k != "@container"}
        items = [o for v in values for o in objects(v, ctx, plain, out)]
        cells = [blank.new() for _ in items] + [RDF + "nil"]
        for cell, item, rest in zip(cells, items, cells[1:]):
            out.append((cell, RDF + "first", *item))
            out.append((cell, RDF + "rest", rest, term(rest), None, None))
        return cells[0], term(cells[0]), None, None

    def node(obj: dict, ctx: _Context, out: list) -> str:
        if "@context" in obj:
            ctx = ctx.extended(obj["@context"])
        alias = lambda k: ctx.terms.get(k) if isinstance(ctx.terms.get(k), str) and ctx.terms[k].startswith("@") else k
        entries = {alias(k): (k, v) for k, v in obj.items()}
        subject = label(ctx.iri(entries["@id"][1], False)) if "@id" in entries else blank.new()
        types = entries.get("@type", (None, []))[1]
        for t in types if isinstance(types, list) else [types]:
            name = ctx.iri(t, True)
            if name:
                out.append((subject, RDF + "type", label(name), term(name), None, None))
        for keyword, (name, value) in entries.items():
            if keyword == "@graph":
                for part in value if isinstance(value, list) else [value]:
                    node(part, ctx, out)
            elif keyword == "@reverse":
                for p, v in value.items():
                    for part in v if isinstance(v, list) else [v]:
                        other = node(part, ctx, out) if isinstance(part, dict) else label(ctx.iri(part, False))
                        out.append((other, ctx.iri(p, True), subject, term(subject), None, None))
            elif not keyword.startswith("@"):
                predicate = ctx.iri(name, True)
                if predicate is None or predicate.startswith("_:") or ":" not in predicate:
                    continue
                definition = ctx.terms.get(name) if isinstance(ctx.terms.get(name), dict) else {}
                for o in objects(value, ctx, definition, out):
                    out.append((subject, predicate, *o))
        return subject

    document = json.loads(text)
    out: list[tuple] = []
    for part in document if isinstance(document, list) else [document]:
        node(part, _Context(), out)
    yield from dict.fromkeys(out)
