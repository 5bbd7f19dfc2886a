"""Chat formatting with a black-box template, by rendering successive prefixes.

A template is any function from turns to one string. For each turn the turns
before it are rendered without and with it; what the second output has beyond
the first is the turn's piece of the formatted conversation. A second output
that does not begin with the first one rewrites history: the turn is marked
with the number of characters taken back. The text's own span inside a piece is
found the same way, by rendering the turn with other texts in its place.

Whole prefixes are rendered, whose cost grows with the square of a
conversation's length and which holds one conversation in a task. For templates
that the caller knows to append only, ``context=n`` renders just the last n turns
before each turn, and each piece again with one turn more: a difference marks
the turn as well, but what is rewritten further back is not seen. Then a
conversation of any length streams through its task, ordered, one turn at a time.

Defined results: null roles and texts are empty; null turns come first, equal
ones in the order of role and text; rows with a null conversation form one
conversation of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, plain

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


class Readable(Protocol):
    """A template whose pieces can be read back."""

    def __call__(self, turns: list[Turn]) -> str: ...

    def read(self, piece: str) -> Turn: ...

    def unescape(self, text: str) -> str: ...


class MarkedTurns:
    """Turns between marks: ``[INST] user [/INST]``, `` assistant</s>``, ``[ROLE name] other [/ROLE]``, after an opening ``<s>``.

    In roles and texts a backslash is doubled, and the first character of
    anything that could be a control string is written as backslash and a letter, so
    that no control string is left and the text can be read back.
    """

    OPEN = "<s>"
    CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:INST|ROLE)[\] ])")
    CODES = {"\\": "\\\\", "<": "\\L", "[": "\\B", "]": "\\E"}
    NAME = re.compile(r"[\\<\[\]]")
    CODED = re.compile(r"\\(.)", re.S)
    TEXTS = {"\\": "\\", "L": "<", "B": "[", "E": "]"}
    FORMS = (("user", "[INST] ", " [/INST]"), ("assistant", " ", "</s>"))

    def escape(self, text: str) -> str:
        return self.CONTROL.sub(lambda m: self.CODES[m[0]], text)

    def unescape(self, text: str) -> str:
        return self.CODED.sub(lambda m: self.TEXTS[m[1]], text)

    def __call__(self, turns: list[Turn]) -> str:
        marks = {role: (a, b) for role, a, b in self.FORMS}
        out = [self.OPEN]
        for role, text in turns:
            a, b = marks.get(role) or (f"[ROLE {self.NAME.sub(lambda m: self.CODES[m[0]], role)}] ", " [/ROLE]")
            out += a, self.escape(text), b
        return "".join(out)

    def read(self, piece: str) -> Turn:
        """Role and text of the one turn in a piece."""
        piece = piece.removeprefix(self.OPEN)
        for role, a, b in self.FORMS:
            if piece.startswith(a) and piece.endswith(b):
                return role, self.unescape(piece[len(a):-len(b)])
        head, _, rest = piece.removeprefix("[ROLE ").partition("] ")
        return self.unescape(head), self.unescape(rest.removesuffix(" [/ROLE]"))


def piece_of(template: Template, before: list[Turn], turn: Turn) -> tuple[str, int]:
    """What a turn adds, and how many characters of the earlier output it takes back."""
    old = template(before) if before else ""
    new = template([*before, turn])
    if new.startswith(old):
        return new[len(old):], 0
    same = len(os.path.commonprefix((old, new)))
    return new[same:], len(old) - same


def text_span(template: Template, before: list[Turn], role: str, piece: str) -> tuple[int, int]:
    """Where the turn's text lies in its piece: what stays when other texts stand in its place, stays outside."""
    one, _ = piece_of(template, before, (role, "a"))
    two, _ = piece_of(template, before, (role, "b"))
    head = len(os.path.commonprefix((one, two)))
    tail = len(os.path.commonprefix((one[::-1], two[::-1])))
    return head, len(piece) - tail


SCHEMA = ("conv_id long, position long, role string, piece string, start long, end long, loss_start long, loss_end long, "
          "taken_back long, agrees boolean")


def format_turns(turns: DataFrame, template: Template, context: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per turn, in order within its task: its piece, the span in the conversation, the span of text under the loss mask.

    ``turns`` has conv_id, turn, role and text. ``taken_back`` counts characters
    of earlier output that the turn rewrote; ``agrees`` says whether one turn more of context gives the same piece.
    """
    bound_batches(turns.sparkSession)
    ordered = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), plain("role").alias("role"), plain("text").alias("text"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, position, at = None, True, 0, 0
        held: deque[Turn] = deque(maxlen=None if context is None else context + 1)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if first or conv != current:
                    current, first, position, at = conv, False, 0, 0
                    held.clear()
                history = list(held)
                before = history if context is None else history[-context:] if context else []
                piece, back = piece_of(template, before, (role, text))
                agrees = len(before) == len(history) or piece_of(template, history, (role, text)) == (piece, back)
                at -= back
                low, high = (None, None)
                if role == loss_role:
                    a, b = text_span(template, before, role, piece)
                    low, high = at + a, at + b
                for n, v in zip(names, (conv, position, role, piece, at, at + len(piece), low, high, back, agrees), strict=True):
                    out[n].append(v)
                at += len(piece)
                position += 1
                held.append((role, text))
            yield pa.RecordBatch.from_pydict({
                n: pa.array(v, pa.string() if n in ("role", "piece") else pa.bool_() if n == "agrees" else pa.int64()) for n, v in out.items()})

    return ordered.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, template: Readable) -> DataFrame:
    """One row per conversation, read from its pieces as they stream by.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (the unescaped text under the loss mask),
    formatted_chars, n_rewrites (turns that rewrote history or need more context).
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_rewrites", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, conv = True, None
        n = chars = loss = odd = 0
        whole, masked = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "piece", "start", "end", "loss_start", "loss_end", "taken_back", "agrees")]
            for c, piece, start, end, low, high, back, agrees in zip(*columns, strict=True):
                if first or c != conv:
                    if not first:
                        done.append((conv, n, whole.hexdigest(), loss, masked.hexdigest(), chars, odd))
                    first, conv = False, c
                    n = chars = loss = odd = 0
                    whole, masked = hashlib.sha256(), hashlib.sha256()
                role, text = template.read(piece)
                whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if low is not None:
                    own = template.unescape(piece[low - start:high - start])
                    loss += len(own)
                    masked.update(own.encode("utf-8", "surrogatepass"))
                n, chars, odd = n + 1, end, odd + (back > 0 or not agrees)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if not first:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, [[x] for x in (conv, n, whole.hexdigest(), loss, masked.hexdigest(), chars, odd)],
                                                      strict=True)), schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                     "formatted_chars long, n_rewrites long")
