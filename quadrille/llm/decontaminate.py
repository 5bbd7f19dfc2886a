"""Benchmark passages in documents, by Wu-Manber search over words.

A window is a run of item words. Windows of equal length form one class with a
shift table over hashed pairs of neighbouring words: at each position the pair
that ends the current alignment says how far the search may skip, and only a
shift of zero leads to the bucket of windows with that last pair, which are
compared word by word. Words that no item has can end no window, so most of a
clean document is skipped a whole window at a time.

Items are cut into pieces that share all but one word of a window, and pieces
dealt out to blocks of a bounded number of words. A task builds the tables of a
block and writes them; the driver only hands one block after another on. The
documents pass a few blocks at a time, without a shuffle, and carry their
findings along, which are written before the next blocks are sent and the
earlier ones released.

Defined results: null has no words and is never contaminated; items without
words have no window; items with a null id are passed over in ``item_ids`` but
their windows hit; repeated items count once. Empty tables: no
documents give no rows, no items leave every document clean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import KEPT, bound_batches, plain, shared_bytes
from quadrille.session import materialise

WINDOW = 10
# Words of the items in one block; what a task holds is bounded by this. Tables are written in parts of so many bytes.
BLOCK_WORDS, PART = 1_000_000, 8 << 20

# A-Z to a-z, other ASCII characters that are not letters or digits to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Windows of one length, over word numbers; number 0 is no item's word."""

    def __init__(self, windows: dict[tuple[int, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple[int, ...], int] = {}
        self.bucket: dict[tuple[int, ...], list[tuple[tuple[int, ...], list[int]]]] = {}
        self.far = length - self.block + 1
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                pair = window[end - self.block:end]
                self.shift[pair] = min(self.shift.get(pair, self.far), length - end)
            self.bucket.setdefault(window[-self.block:], []).append((window, items))

    def search(self, ids: tuple[int, ...]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence."""
        shift, bucket, far, block, length = self.shift, self.bucket, self.far, self.block, self.length
        at, end = length, len(ids)
        while at <= end:
            pair = ids[at - block:at]
            step = shift.get(pair, far)
            if step:
                at += step
                continue
            found = ids[at - length:at]
            for window, items in bucket[pair]:
                if window == found:
                    yield at - length, items
            at += 1


class Patterns:
    """All windows of a block of items."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names: list[str | None] = []
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for name, words in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            if not ids:
                continue
            self.names.append(name)
            length = min(window, len(ids))
            for i in range(len(ids) - length + 1):
                by_length.setdefault(length, {}).setdefault(ids[i:i + length], set()).add(len(self.names) - 1)
        self.classes = [WuManber({w: sorted(s) for w, s in windows.items()}, n) for n, windows in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (start, end) spans of hit words, and the names of items that occur."""
        ids = tuple(map(self.numbers.get, words, [0] * len(words)))
        spans, names = [], set()
        for c in self.classes:
            for start, items in c.search(ids):
                spans.append((start, start + c.length))
                names.update(n for n in (self.names[i] for i in items) if n is not None)
        return merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _tables(benchmark: DataFrame, item: str, text: str, window: int, limit: int) -> DataFrame:
    """(block, part, bytes): the search tables of each block of items, in parts."""
    # A block has half as many words as allowed on average, so that chance may fill it unevenly.
    ahead = max(1, max(limit // 4, 2 * window) - window + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(t)
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), ahead):
                    piece = words[at:at + ahead + window - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([b" ".join(piece)], pa.binary()),
                                                      pa.array([len(piece)], pa.int64())], names=["item", "words", "n"])

    def build(table: pa.Table) -> pa.Table:
        names, pieces = table.column("item").to_pylist(), table.column("words").to_pylist()
        data = cloudpickle.dumps(Patterns(((k, w.split()) for k, w in zip(names, pieces, strict=True)), window))
        parts = [data[i:i + PART] for i in range(0, len(data), PART)]
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int64()),
                         "part": pa.array(range(len(parts)), pa.int64()), "bytes": pa.array(parts, pa.binary())})

    items = benchmark.select(F.col(item).cast("string").alias("item"), plain(text).alias("text")).distinct()
    pieces = materialise(items.mapInArrow(cut, "item string, words binary, n long"), "items")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-2 * total // limit) if total > limit else 1
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    return materialise(dealt.groupBy("block").applyInArrow(build, "block long, part long, bytes binary"), "windows")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, n_words, spans, item_ids): all columns of ``docs`` as ``row``; word spans hit and the items that occur, sorted as strings."""
    spark = docs.sparkSession
    bound_batches(spark)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    state = docs.select(F.struct("*").alias("row"), plain(text).alias("text"), F.lit(None).cast("long").alias("n_words"),
                        F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans"),
                        F.lit(None).cast("array<string>").alias("item_ids"))
    tables = _tables(benchmark, item_id, item_text, window, block_words)
    sent: list = []
    # Without any window one empty block counts the words.
    for block in sorted(r["block"] for r in tables.select("block").distinct().collect()) or [None]:
        if len(sent) == KEPT - 1:
            state = materialise(state, "found")
            while sent:
                sent.pop().destroy()
        parts = [bytes(r["bytes"]) for r in tables.filter(F.col("block") == block).orderBy("part").collect()]
        sent.append(spark.sparkContext.broadcast(b"".join(parts) or cloudpickle.dumps(Patterns((), window))))
        patterns = shared_bytes(sent[-1])

        def run(batches: Iterator[pa.RecordBatch], patterns=patterns) -> Iterator[pa.RecordBatch]:
            find = patterns().find
            for batch in batches:
                n, spans, names = [], [], []
                for t, s, k in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "item_ids")), strict=True):
                    words = words_of(t)
                    at, found = find(words)
                    n.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged(at + [(x["start"], x["end"]) for x in s or []])])
                    names.append(sorted(found.union(k or [])))
                columns = {"n_words": pa.array(n, pa.int64()), "spans": pa.array(spans, pa.list_(span)),
                           "item_ids": pa.array(names, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)],
                                                 names=batch.schema.names)

        state = state.mapInArrow(run, state.schema)
    return state.drop("text")


def report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col(f"row.{id_column}").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
