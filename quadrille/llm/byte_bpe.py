"""Byte-level BPE of whole texts by a global shuffle of distinct words.

Texts are split into pre-tokens. A pre-token that is itself an entry of the
vocabulary has its id at once; of the others each block of documents lists the
distinct ones, and keeps where they stand as numbers into that list. The lists
are dealt out by a hash of the word, each distinct word is merged once where it
arrives, and the ids go back to the block, where the documents are put together
again by position. Blocks and lists travel as compressed arrays.

The blocks are cut in the order rows are read, so the input has to give the
same rows to a task that is run again: files, or anything written before.

Decoding looks the bytes of each id up in the vocabulary's own table.

Defined results: null and empty texts have no ids and decode to no bytes;
repeated rows and null ids are encoded like others. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from quadrille.llm.common import bound_batches, per_process, with_row
from quadrille.llm.pretokens import pattern

# Characters of text in one block, and in one slice of a very long text.
BLOCK_CHARS = 1 << 23
SLICE = 1 << 20
# Distinct words a task remembers while it encodes lists.
MEMORY = 250_000
# Documents in one batch of a block that is put together.
BATCH_ROWS = 256


@per_process
def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks by token bytes, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@per_process
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks = vocabulary(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


@per_process
def _merger(path: str):
    """Ids of one word: the merges of the vocabulary, without any splitting."""
    import tiktoken

    return tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary(path), special_tokens={}).encode_ordinary


class Index(dict):
    """Numbers of pre-tokens: ids of the vocabulary first, then new words as they come."""

    def __init__(self, base: dict[str, int], first: int):
        super().__init__(base)
        self.first, self.words = first, []

    def __missing__(self, word: str) -> int:
        number = self[word] = self.first + len(self.words)
        self.words.append(word)
        return number


def _packed(array: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress better."""
    import zstandard

    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _numbered(text: str, index: Index) -> Iterator[np.ndarray]:
    """The numbers of a text's pre-tokens, a bounded piece at a time."""
    split = pattern()
    if len(text) <= SLICE:
        yield np.array([index[w] for w in split.findall(text)], np.uint32)
        return
    held: list[int] = []
    for m in split.finditer(text):
        held.append(index[m[0]])
        if len(held) >= SLICE:
            yield np.array(held, np.uint32)
            held = []
    yield np.array(held, np.uint32)


def _cut(path: str, buckets: int, block_chars: int):
    """Rows (block, bucket, payload): the documents of a block as bucket -1, its new words by bucket."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary(path)
        first = max(ranks.values()) + 1
        base = {}
        for token, rank in ranks.items():
            try:
                base[token.decode()] = rank
            except UnicodeDecodeError:
                continue
        task, blocks = TaskContext.get().partitionId(), 0
        index, rows, lengths, places, chars = Index(base, first), [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal index, rows, lengths, places, chars, blocks
            block = (task << 24) + blocks
            words = [w.encode() for w in index.words]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint16, len(words))
            sink = pa.BufferOutputStream()
            table = pa.table({"row": pa.concat_arrays(rows)})
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            parts = [sink.getvalue().to_pybytes(), _packed(np.array(lengths, np.uint32)), _packed(np.concatenate([*places, np.empty(0, np.uint32)])),
                     _packed(bucket)]
            yield _row(block, -1, np.array([len(p) for p in parts], np.uint64).tobytes() + b"".join(parts))
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                sizes = np.array([len(words[i]) for i in own], np.uint32)
                blob = b"".join(words[i] for i in own)
                yield _row(block, int(bucket[own[0]]), zstandard.ZstdCompressor(level=3).compress(
                    np.uint32(len(own)).tobytes() + sizes.tobytes() + blob))
            index, rows, lengths, places, chars, blocks = Index(base, first), [], [], [], 0, blocks + 1

        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                n = 0
                for part in _numbered(text, index):
                    places.append(part)
                    n += len(part)
                lengths.append(n)
                chars += len(text)
                if chars >= block_chars:
                    rows.append(batch.column("row")[at:i + 1])
                    at = i + 1
                    yield from flush()
            if at < batch.num_rows:
                rows.append(batch.column("row")[at:])
        if rows:
            yield from flush()

    return run


def _row(block: int, bucket: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bucket": pa.array([bucket], pa.int32()),
                                       "payload": pa.array([payload], pa.binary())})


def _encode_lists(path: str):
    """Lists of words become lists of ids: how many each word has, then all of them."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, known = _merger(path), {}
        for batch in batches:
            for block, bucket, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket < 0:
                    continue
                data = zstandard.ZstdDecompressor().decompress(payload)
                n = int(np.frombuffer(data, np.uint32, 1)[0])
                ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
                at, ids = 4 + 4 * n, []
                for end in ends.tolist():
                    word = data[at:end]
                    got = known.get(word)
                    if got is None:
                        if len(known) >= MEMORY:
                            known.clear()
                        got = known[word] = merge(word.decode())
                    ids.append(got)
                    at = end
                counts = _packed(np.array([len(x) for x in ids], np.uint32))
                yield _row(block, bucket, np.uint64(len(counts)).tobytes() + counts + _packed(np.array([y for x in ids for y in x], np.uint32)))

    return run


def _gather(starts: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Positions of the runs ``order`` one after another, run ``i`` being ``starts[i]`` and on."""
    n = counts[order]
    ends = np.cumsum(n, dtype=starts.dtype)
    out = np.repeat(starts[order] - (ends - n), n)
    out += np.arange(len(out), dtype=starts.dtype)
    return out


def _assemble(path: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        payload = next(p for b, p in zip(left.column("bucket").to_pylist(), left.column("payload").to_pylist(), strict=True) if b < 0)
        sizes = np.frombuffer(payload, np.uint64, 4).astype(int)
        cuts = np.cumsum(np.r_[32, sizes])
        parts = [payload[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        rows = pa.ipc.open_stream(parts[0]).read_all().column("row")
        lengths, places, bucket = _unpacked(parts[1], np.uint32), _unpacked(parts[2], np.uint32), _unpacked(parts[3], np.uint16)
        vocabulary_size = len(token_bytes(path))
        # Runs of ids: one id each for the vocabulary, then the block's words in its own order.
        # A block has fewer than 2 ** 31 ids, as its lists could not hold more.
        counts = np.ones(vocabulary_size + len(bucket), np.int32)
        starts = np.zeros(vocabulary_size + len(bucket), np.int32)
        starts[:vocabulary_size] = np.arange(vocabulary_size)
        pool, base = [np.arange(vocabulary_size, dtype=np.int32)], vocabulary_size
        order = np.argsort(bucket, kind="stable")
        by_bucket = dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            data = by_bucket[int(bucket[own[0]])]
            size = int(np.frombuffer(data, np.uint64, 1)[0])
            n, ids = _unpacked(data[8:8 + size], np.uint32).astype(np.int32), _unpacked(data[8 + size:], np.uint32).astype(np.int32)
            counts[vocabulary_size + own] = n
            starts[vocabulary_size + own] = base + np.cumsum(n) - n
            pool.append(ids)
            base += len(ids)
        pooled = np.concatenate(pool)
        tokens = pooled[_gather(starts, counts, places)]
        # Tokens of each document: the sum over its places.
        done = np.zeros(len(places) + 1, np.int32)
        np.cumsum(counts[places], out=done[1:])
        offsets = done[np.r_[0, np.cumsum(lengths, dtype=np.int64)]].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens, pa.int32()))
        whole = pa.table({"row": rows.combine_chunks(), "ids": ids})
        return pa.Table.from_batches(whole.to_batches(max_chunksize=BATCH_ROWS), whole.schema)

    return run


def encode(docs: DataFrame, path: str, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(row, ids): the other columns of ``docs`` as ``row``; ``path`` names a rank file every executor has."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = with_row(docs, text, drop_text=True)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(partitions, 1 << 15)
    kind = "block long, bucket int, payload binary"
    # One shuffle holds documents and lists; both branches below read it.
    cut = rows.mapInArrow(_cut(path, buckets, block_chars), kind).repartition(partitions, "block")
    lists = cut.select("block", "bucket", F.when(F.col("bucket") >= 0, F.col("payload")).alias("payload"))
    merged = lists.mapInArrow(_only_lists, kind).repartition(partitions, "bucket").mapInArrow(_encode_lists(path), kind)
    row = rows.schema["row"]
    out = StructType([StructField("row", row.dataType), StructField("ids", ArrayType(IntegerType()))])
    return cut.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(_assemble(path), out)


def _only_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.filter(pa.compute.greater_equal(batch.column("bucket"), 0))
        if kept.num_rows:
            yield kept


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the bytes of its ids as ``decoded``."""
    bound_batches(encoded.sparkSession)
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = token_bytes(path).__getitem__
        for batch in batches:
            lists = batch.column(ids)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            out = [b"".join(map(look, values[a:b].tolist())) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
