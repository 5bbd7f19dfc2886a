"""Per-document text helpers that Column expressions cannot express.

Each works on one document and returns offsets in code points; Spark decides
where documents are processed.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

_HIDDEN = {"script", "style", "template", "noscript", "title"}
_BREAKS = {"p", "div", "li", "ul", "ol", "article", "section", "nav", "header", "footer", "main", "br", "tr", "table",
           "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "caption", "body", "html", "form"}
_SPACE = re.compile(r"\s+")
_SPAN = re.compile("[1-9][0-9]{0,5}")
_TOKEN = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?]+[\"')\]]*(?=\s|$)|\n+")


class _Blocks(HTMLParser):
    """Collects blocks in reading order: paragraphs, headings and tables."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.text: list[str] = []
        self.hidden = 0
        self.level = 0
        self.table: dict | None = None
        self.cell: dict | None = None
        self.inner = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if not text:
            return
        if self.table is not None:
            if self.cell is None:
                self.table["caption"] = text
        elif self.level:
            self.blocks.append(("heading", text, self.level))
        else:
            self.blocks.append(("text", text))

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "table" and self.cell is not None:
            # The text of a table inside a cell belongs to the cell.
            self.inner += 1
            self.text.append(" ")
        elif self.inner:
            self.text.append(" ")
        elif tag == "table":
            self.flush()
            if self.table is None:
                self.table = {"caption": None, "cells": [], "row": -1, "taken": []}
        elif self.table is not None and tag == "tr":
            self.close_cell()
            self.table["row"] += 1
        elif self.table is not None and tag in ("td", "th"):
            self.close_cell()
            self.open_cell(dict(attrs))
        elif tag in _BREAKS and self.cell is None:
            self.flush()
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                self.level = int(tag[1])
        elif tag in _BREAKS:
            self.text.append(" ")

    def open_cell(self, attrs) -> None:
        self.text = []
        t = self.table
        t["row"] = max(t["row"], 0)
        span = lambda k: int(attrs[k]) if _SPAN.fullmatch(str(attrs.get(k) or "")) else 1
        # Ranges of columns that earlier cells occupy, each up to a last row.
        t["taken"] = [x for x in t["taken"] if x[2] >= t["row"]]
        col = 0
        for first, end, _ in sorted(t["taken"]):
            if first <= col < end:
                col = end
        self.cell = {"row": t["row"], "col": col, "row_span": span("rowspan"), "col_span": span("colspan")}
        t["taken"].append((col, col + self.cell["col_span"], t["row"] + self.cell["row_span"] - 1))

    def close_cell(self) -> None:
        if self.cell is not None:
            self.cell["text"] = _SPACE.sub(" ", "".join(self.text)).strip()
            self.table["cells"].append(self.cell)
            self.cell, self.text = None, []

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.inner:
            self.inner -= tag == "table"
            self.text.append(" ")
        elif self.table is not None and tag in ("td", "th", "tr"):
            self.close_cell()
        elif self.table is not None and tag == "table":
            self.close_table()
        elif tag in _BREAKS and self.cell is None:
            self.flush()
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                self.level = 0

    def close_table(self) -> None:
        self.inner = 0
        self.close_cell()
        if self.table["cells"]:
            self.blocks.append(("table", self.table["caption"], self.table["cells"]))
        self.table = None

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def finish(self) -> list[tuple]:
        self.close()
        if self.table is not None:
            self.close_table()
        self.flush()
        return self.blocks


def parse_html(html: str) -> dict:
    """Text in Markdown form with the sections and tables found, by offset."""
    parser = _Blocks()
    parser.feed(html)
    pieces: list[str] = []
    sections, tables, at = [], [], 0
    for kind, *rest in parser.finish():
        if pieces:
            pieces.append("\n\n")
            at += 2
        if kind == "text":
            piece = rest[0]
        elif kind == "heading":
            marks = "#" * rest[1] + " "
            piece = marks + rest[0]
            sections.append({"heading": rest[0], "level": rest[1], "char_start": at + len(marks), "char_end": at + len(piece)})
        else:
            caption, cells = rest
            rows: dict[int, list[str]] = {}
            for cell in cells:
                rows.setdefault(cell["row"], []).append(cell["text"])
            lines = ["| " + " | ".join(rows[r]) + " |" for r in sorted(rows)]
            piece = "\n".join(([caption] if caption else []) + lines)
            tables.append({"caption": caption, "cells": cells, "char_start": at, "char_end": at + len(piece)})
        pieces.append(piece)
        at += len(piece)
    return {"text": "".join(pieces), "sections": sections, "tables": tables}


def _sentences(text: str, size: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of sentences; longer ones are cut between tokens."""
    bounds, at = [], 0
    for found in _SENTENCE_END.finditer(text):
        bounds.append((at, found.end()))
        at = found.end()
    bounds.append((at, len(text)))
    out = []
    for start, end in bounds:
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        for i in range(0, len(tokens), size):
            part = tokens[i : i + size]
            out.append((part[0][0], part[-1][1], len(part)))
    return out


def chunk_spans(text: str, size: int = 512, overlap: int = 50) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of chunks: whole sentences, at most ``size`` tokens.

    A chunk starts with the last sentences of the one before it as long as they
    have no more than ``overlap`` tokens together.
    """
    sentences = _sentences(text, size)
    out, first = [], 0
    while first < len(sentences):
        last, total = first, 0
        while last < len(sentences) and total + sentences[last][2] <= size:
            total += sentences[last][2]
            last += 1
        out.append((sentences[first][0], sentences[last - 1][1], total))
        if last == len(sentences):
            break
        back, kept = last, 0
        # Room for the next sentence must remain beside the repeated ones.
        while (back - 1 > first and kept + sentences[back - 1][2] <= overlap
               and kept + sentences[back - 1][2] + sentences[last][2] <= size):
            back -= 1
            kept += sentences[back][2]
        first = back
    return out
