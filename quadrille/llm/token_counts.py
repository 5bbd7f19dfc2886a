"""Token counts of whole texts, huge ones in overlapping chunks.

A text longer than a chunk is cut into chunks that overlap, and the chunks are
dealt out over the cluster. Each is encoded on its own with the places where a
pre-token begins and the number of tokens before it. Where the encodings of
two neighbours begin a pre-token at the same place inside their overlap, both
go on alike from there, since splitting looks ahead a few characters and never
back; so the left chunk counts up to that place and the right one from it on.
Places nearer to the end of the left chunk than the splitter looks ahead are
no proof and are passed over. A pair without a proven place is encoded again
with a wider overlap until it has one or the overlap holds the whole text.

Distinct pre-tokens are counted by the library once in a while per task; texts
repeat them, so a bounded table of their counts saves most calls.

Defined results: null and empty texts have no bytes and no tokens; repeated
rows and null ids are counted like others. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, map_texts, per_process, with_row
from quadrille.llm.pretokens import splitter
from quadrille.session import materialise

CHUNK = 1 << 16
OVERLAP = 1 << 9
# Characters the splitter looks ahead of a match: a contraction such as 're.
LOOK_AHEAD = 3
# Pre-tokens whose counts a task remembers.
MEMORY = 500_000
LIMIT = 1024


class Counter:
    """Counts tokens of pre-tokens as the library does, remembering them."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory, self.known = memory, {}
        # Strings the library takes out of a text before it is split; each is one token.
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.split = splitter()
        self.look_ahead = max([LOOK_AHEAD, *map(len, self.special)])

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and special strings, which concatenate to the text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = [p for p in set(pieces) if p not in known]
        if new:
            if len(known) + len(new) > self.memory:
                known.clear()
                new = list(set(pieces))
            known.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [known[p] for p in pieces]

    def count(self, text: str) -> int:
        return sum(self.counts(self.pieces(text)))

    def places(self, text: str) -> tuple[list[int], list[int]]:
        """Where each pre-token begins, and the tokens before it; the end of the text closes both."""
        at, before, starts, totals = 0, 0, [], []
        pieces = self.pieces(text)
        for piece, n in zip(pieces, self.counts(pieces), strict=True):
            starts.append(at)
            totals.append(before)
            at += len(piece)
            before += n
        return [*starts, at], [*totals, before]


@per_process
def counter(path: str) -> Counter:
    """One counter per worker process and tokenizer."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path)


def _encoded(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, seam, side, place, before, total) lists for both ends of each chunk.

    Seam ``i`` lies between the chunks ``i`` and ``i + 1``. Places are characters
    from the beginning of the text.
    """
    kind = pa.schema([("key", pa.int64()), ("seam", pa.int64()), ("side", pa.string()), ("place", pa.list_(pa.int64())),
                      ("before", pa.list_(pa.int64())), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in kind.names}
            for key, number, last, text in zip(*(batch.column(n).to_pylist() for n in ("key", "number", "last", "piece")), strict=True):
                starts, totals = c.places(text)
                origin = number * chunk

                def add(seam: int, side: str, low: int, high: int, total: int | None = None) -> None:
                    a, b = bisect_left(starts, low), bisect_left(starts, high)
                    for n, v in zip(kind.names, (key, seam, side, [x + origin for x in starts[a:b]], totals[a:b], total), strict=True):
                        out[n].append(v)

                if number:
                    # A chunk's own beginning is no place that its encoding found.
                    add(number - 1, "right", 1, overlap)
                if last:
                    add(number, "end", 0, 0, totals[-1])
                else:
                    add(number, "left", chunk, chunk + overlap - c.look_ahead + 1)
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    return chunks.mapInArrow(run, "key long, seam long, side string, place array<long>, before array<long>, total long")


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of (key, text); null where neighbours have no proven common place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last = max(0, (len(text) - 1) // chunk)
                for number in range(last + 1):
                    at = number * chunk
                    yield pa.RecordBatch.from_pydict({
                        "key": [key], "number": pa.array([number], pa.int64()), "last": [number == last],
                        "piece": [text[at:] if number == last else text[at:at + chunk + overlap]]})

    chunks = texts.select("key", "text").mapInArrow(cut, "key long, number long, last boolean, piece string").repartition("key", "number")
    ends = _encoded(chunks, path, chunk, overlap)
    one = lambda side, name: F.first(F.when(F.col("side") == side, F.col(name)), ignorenulls=True).alias(f"{side}_{name}")
    seams = ends.groupBy("key", "seam").agg(one("left", "place"), one("left", "before"), one("right", "place"), one("right", "before"), one("end", "total"))
    place = F.array_min(F.array_intersect("left_place", "right_place"))
    before = lambda side: F.element_at(f"{side}_before", F.array_position(f"{side}_place", F.col("common")).cast("int"))
    value = F.when(F.col("end_total").isNotNull(), F.col("end_total")).when(F.col("common").isNotNull(), before("left") - before("right"))
    return (seams.withColumn("common", place).withColumn("value", value).groupBy("key")
            .agg(F.when(F.bool_and(F.col("value").isNotNull()), F.sum("value")).alias("n_tokens")))


def token_counts(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, n_bytes, n_tokens): the other columns of ``docs`` as ``row``; ``path`` names a tokenizer file every executor has."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = with_row(docs, text, drop_text=True).withColumn("n_bytes", F.octet_length("text").cast("long"))
    small, huge = rows.filter(F.length("text") <= chunk), rows.filter(F.length("text") > chunk)

    def make():
        count = counter(path).count
        return lambda texts: {"n_tokens": list(map(count, texts))}

    done = [map_texts(small, make, "n_tokens long")]
    left = materialise(huge.withColumn("key", F.monotonically_increasing_id()), "huge_texts")
    while not left.isEmpty():
        counted = materialise(_spliced(left, path, chunk, overlap), "huge_counts")
        done.append(left.select("row", "n_bytes", "key").join(counted.filter("n_tokens IS NOT NULL"), "key").select("row", "n_bytes", "n_tokens"))
        again = counted.filter("n_tokens IS NULL").select("key")
        overlap *= 8
        # An overlap as long as the text leaves it in one piece.
        chunk = max(chunk, 2 * overlap)
        left = materialise(left.join(again, "key", "left_semi").select("row", "text", "n_bytes", "key"), "huge_texts")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
