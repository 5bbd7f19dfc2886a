"""Exact duplicates by counting quotient filters and byte verification.

Each task turns the 64-bit fingerprints of its documents into a counting
quotient filter: the high bits (the quotient) name a block, the low bits (the
remainder) are kept sorted within it, with a count each. Filters of different
tasks merge without loss, by adding the counts of equal remainders of a block.
Fingerprints with a count above one are candidates; only their texts are
compared, byte for byte.

Defined results: a null text counts as empty; white space alone equals empty;
a null ``doc_id`` is larger than any other and may be a keeper only when all
ids of its group are null; of rows equal in all of id, text and length one is
kept and the others are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, map_texts, plain, with_row
from quadrille.session import materialise

# Deleted before texts are compared (fixed values).
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

# Quotient blocks of the merged filter per shuffle partition, and fingerprints
# a task gathers before it passes its filter on.
BLOCKS_PER_PARTITION = 16
FILTER_ROWS = 1 << 20


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, WHITE_SPACE)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, n_points, sha, fp): all columns as ``row``, the normalised text's digest and 64-bit fingerprint."""
    def make():
        def of(texts: list[str]) -> dict[str, list]:
            shas = [hashlib.sha256(normalised(t)).digest() for t in texts]
            fps = np.frombuffer(b"".join(s[:8] for s in shas), dtype=">i8")
            return {"n_points": [len(t) for t in texts], "sha": shas, "fp": fps.astype("int64").tolist()}
        return of

    return map_texts(with_row(docs, text), make, "n_points long, sha binary, fp long")


class QuotientFilter:
    """Sorted remainders with counts, by quotient."""

    def __init__(self, quotient_bits: int):
        self.shift = np.uint64(64 - quotient_bits)

    def build(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(quotient, remainders, counts) of int64 fingerprints."""
        values, counts = np.unique(fps.view(np.uint64), return_counts=True)
        quotients = values >> self.shift
        cuts = np.flatnonzero(np.diff(quotients)) + 1
        for q, v, c in zip(np.r_[quotients[:1], quotients[cuts]], np.split(values, cuts), np.split(counts, cuts), strict=False):
            if len(v):
                yield int(q), v & ((np.uint64(1) << self.shift) - np.uint64(1)), c

    def merge(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the counts of equal remainders of one block."""
        remainders = np.concatenate([r for r, _ in parts])
        order = np.argsort(remainders, kind="stable")
        remainders, counts = remainders[order], np.concatenate([c for _, c in parts])[order]
        starts = np.flatnonzero(np.r_[True, remainders[1:] != remainders[:-1]])
        return remainders[starts], np.add.reduceat(counts, starts)

    def fingerprint(self, quotient: int, remainders: np.ndarray) -> np.ndarray:
        return ((np.uint64(quotient) << self.shift) | remainders).view(np.int64)


def repeated_fingerprints(fps: DataFrame, quotient_bits: int | None = None) -> DataFrame:
    """Values of the long column ``fp`` that occur more than once: (fp, n)."""
    spark = fps.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = quotient_bits or max(4, (partitions * BLOCKS_PER_PARTITION - 1).bit_length())
    cqf = QuotientFilter(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            blocks = list(cqf.build(np.concatenate(held))) if held else []
            held.clear()
            if blocks:
                yield pa.RecordBatch.from_pydict({
                    "block": [q for q, _, _ in blocks], "remainders": [r.tobytes() for _, r, _ in blocks],
                    "counts": [c.astype(np.int64).tobytes() for _, _, c in blocks]})

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= FILTER_ROWS:
                yield from flush()
        yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        parts = [(np.frombuffer(r, np.uint64), np.frombuffer(c, np.int64))
                 for r, c in zip(table.column("remainders").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        remainders, counts = cqf.merge(parts)
        many = counts > 1
        return pa.table({"fp": cqf.fingerprint(block, remainders[many]), "n": counts[many]})

    filters = fps.select("fp").mapInArrow(build, "block long, remainders binary, counts binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The longest original text of a group stays, then the smallest id.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    marked = fingerprints(docs.select(id_column, text), text)
    # Rows equal in everything become one row with a number, here and in what follows.
    ids = materialise(marked.select(F.col(f"row.{id_column}").alias("doc_id"), "n_points", "sha", "fp"), "exact_ids")
    repeated = materialise(repeated_fingerprints(ids), "exact_repeated")
    candidates = marked.join(repeated.select("fp"), "fp", "left_semi")
    norm = F.regexp_replace(plain(f"row.{text}"), "[\\x20\\x09-\\x0D]+", "")
    # The bytes decide: a class is one normalised text.
    best = F.struct(F.col("n_points"), F.col(f"row.{id_column}").isNotNull().alias("has"), (-F.col(f"row.{id_column}")).alias("neg"))
    classes = (candidates.groupBy("fp", norm.alias("norm"))
               .agg(F.max(best).alias("best"), F.count("*").alias("group_size"), F.first("sha").alias("sha"))
               .select("sha", "group_size", F.col("best.n_points").alias("best_points"), (-F.col("best.neg")).alias("keep_id")))
    rows = ids.groupBy("doc_id", "n_points", "sha", "fp").agg(F.count("*").alias("times"))
    single = rows.join(repeated.select("fp"), "fp", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    several = (rows.join(repeated.select("fp"), "fp", "left_semi").join(classes, "sha")
               .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
               .select("doc_id", "keep_id", "group_size",
                       ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
                        & (F.col("n_points") == F.col("best_points"))).alias("kept"), "sha"))
    return single.unionByName(several).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
