"""Near copies: groups of documents linked by the exact Jaccard similarity of their word shingles.

Documents with equal shingle sets are one node. Nodes are laid out in cells by
the size of their sets: of two sets within the threshold the smaller has at
least that share of the larger, so only neighbouring cells meet. These are cut
into tiles of bounded size, and each pair of tiles is compared in full:

* fingerprints (64-bit majorities of the shingle hashes) within ``RADIUS``.
  Two sets of similarity 0.8 share 0.89 of their shingles, so each bit differs
  with probability arccos(0.89) / pi = 0.15: 9.7 bits on average, with a deviation of 2.9;
* then the counts of shingles by ``BUCKETS`` hash buckets, whose differences
  sum to no more than the shingles that only one of the sets has; sets of
  ``LARGE`` shingles and more have ``FINE`` buckets as well.

What remains is a candidate and is confirmed by its two shingle sets. Only the
first test can lose a pair. A first round takes one candidate of each node and
tile, so that a dense group is joined by about as many pairs as it has members; the
second takes all candidates between nodes not yet in one group.

Defined results: a null text is an empty one; documents without words are
linked to each other; one of fewer words than a shingle has one shingle. The
rest is as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, map_texts, plain
from quadrille.llm.simhash import SEED, first_of_each, linked_groups, majority, shingle_hashes
from quadrille.session import materialise

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
BUCKETS = 64
LARGE, FINE = 1000, 1024
TILE = 8192
# Fingerprints and candidates compared at once.
COMPARED, SIFTED = 1 << 20, 1 << 16


def shingle_set(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    return np.unique(np.array(shingle_hashes(text, shingle, seed), np.uint64))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a shingle set."""
    from xxhash import xxh64_intdigest

    return int(np.array(xxh64_intdigest(shingles.tobytes(), SEED), np.uint64).view(np.int64))


def bucket_counts(shingles: np.ndarray, buckets: int) -> bytes:
    """Shingles by hash bucket, a byte each. Cut at 255 the counts still differ by no more than the sets."""
    counts = np.bincount((shingles % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _marked(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(id, key, fp, n, print, buckets, fine) of each row, written once; ``fp`` names the shingle set, ``n`` is its size."""
    key = F.xxhash64(F.col(id_column), F.col(text))

    def make():
        def of(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"fp": [], "n": [], "print": [], "buckets": [], "fine": []}
            for t in texts:
                own = shingle_set(t)
                out["fp"].append(set_id(own))
                out["n"].append(len(own))
                out["print"].append(int(np.array(majority(own), np.uint64).view(np.int64)))
                out["buckets"].append(bucket_counts(own, BUCKETS))
                out["fine"].append(bucket_counts(own, FINE) if len(own) >= LARGE else None)
            return out
        return of

    rows = docs.select(F.col(id_column).alias("id"), key.alias("key"), plain(text).alias("text"))
    return materialise(map_texts(rows, make, "fp long, n long, print long, buckets binary, fine binary"), "near_marked")


def candidates(nodes: DataFrame, every: bool, similarity: float = SIMILARITY, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, tgt): pairs of nodes with different labels that may reach the similarity; one for each node and tile unless ``every``.

    ``nodes`` has fp (distinct), n, print, buckets, fine and label.
    """
    spark = nodes.sparkSession
    # A little wider than the largest ratio of two sizes, so that rounding cannot put a pair two cells apart.
    width = log(1 / similarity) * 1.0001
    placed = nodes.filter("n > 0").withColumn("cell", F.floor(F.log("n") / width).cast("long"))
    sizes = {r["cell"]: r["c"] for r in placed.groupBy("cell").agg(F.count("*").alias("c")).collect()}
    split = {c: -(-n // tile) for c, n in sizes.items()}
    pairs = [(c, d, split[c], split[d]) for c in sizes for d in (c, c + 1) if d in sizes]
    grid = spark.createDataFrame(pairs, "a long, b long, sa long, sb long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    columns = ["fp", "n", "print", "buckets", "fine", "label", "a", "b"]
    left = placed.join(grid, F.col("cell") == F.col("a")).select(*columns, part("sa").alias("i"), each("sb").alias("j"), F.lit(0).alias("side"))
    right = placed.join(grid, F.col("cell") == F.col("b")).select(*columns, each("sa").alias("i"), part("sb").alias("j"), F.lit(1).alias("side"))
    tiles = (left.filter("a <> b OR i <= j").unionByName(right.filter("a <> b OR i < j"))
             .groupBy("a", "b", "i", "j"))
    apart = (1 - similarity) / (1 + similarity)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("fp")
        fp, n, prints, label, side = (table.column(c).to_numpy() for c in ("fp", "n", "print", "label", "side"))
        prints = prints.view(np.uint64)
        counts = np.array([np.frombuffer(b, np.uint8) for b in table.column("buckets").to_pylist()], np.int16).reshape(-1, BUCKETS)
        fine = [b and np.frombuffer(b, np.uint8).astype(np.int16) for b in table.column("fine").to_pylist()]
        within = table.column("a")[0] == table.column("b")[0] and table.column("i")[0] == table.column("j")[0]
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if within else 1))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        step = max(1, COMPARED // max(1, len(two)))
        for at in range(0, len(one), step):
            x, y = np.nonzero(np.bitwise_count(prints[one[at:at + step], None] ^ prints[two][None, :]) <= radius)
            x, y = one[at + x], two[y]
            # Within a tile each node looks back, so that the nodes of a dense group find the same first one.
            kept = (label[x] != label[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
            kept &= (y < x) if within else True
            x, y = x[kept], y[kept]
            for k in range(0, len(x), SIFTED):
                p, q = x[k:k + SIFTED], y[k:k + SIFTED]
                most = apart * (n[p] + n[q]) + 1e-9
                close = np.abs(counts[p] - counts[q]).sum(axis=1) <= most
                for c in np.flatnonzero(close & (np.minimum(n[p], n[q]) >= LARGE)):
                    close[c] = np.abs(fine[p[c]] - fine[q[c]]).sum() <= most[c]
                found.append((p[close], q[close]))
        x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        if not every:
            # Rows come in order: the first pair of each.
            x, first = np.unique(x, return_index=True)
            y = y[first]
        return pa.table({"src": fp[x], "tgt": fp[y]})

    return tiles.applyInArrow(compare, "src long, tgt long")


def confirmed(pairs: DataFrame, docs: DataFrame, heads: DataFrame, text: str, id_column: str, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (src, tgt) whose shingle sets reach the similarity; ``heads`` has fp and the key of one row with that set."""
    pairs = materialise(pairs.distinct(), "near_candidates")
    asked = pairs.select(F.col("src").alias("fp")).union(pairs.select("tgt")).distinct()
    keys = heads.join(asked, "fp", "left_semi").select("key")
    rows = docs.select(F.xxhash64(F.col(id_column), F.col(text)).alias("key"), plain(text).alias("text")).join(keys, "key", "left_semi")

    def make():
        def of(texts: list[str]) -> dict[str, list]:
            own = [shingle_set(t) for t in texts]
            return {"fp": [set_id(s) for s in own], "shingles": [s.tobytes() for s in own]}
        return of

    sets = map_texts(rows.select("text"), make, "fp long, shingles binary").dropDuplicates(["fp"])
    sets = materialise(sets, "near_sets")
    both = (pairs.join(sets.select(F.col("fp").alias("src"), F.col("shingles").alias("one")), "src")
            .join(sets.select(F.col("fp").alias("tgt"), F.col("shingles").alias("two")), "tgt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("one"), batch.column("two"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.select(["src", "tgt"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.select("src", "tgt", "one", "two").mapInArrow(run, "src long, tgt long"), "near_links")


def near_groups(docs: DataFrame, marked: DataFrame, text: str, id_column: str) -> DataFrame:
    """(fp, component, component_id) of each shingle set: a label and the smallest id of its linked group."""
    heads = materialise(marked.groupBy("fp").agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("n").alias("n"),
                                                 F.first("print").alias("print"), F.first("buckets").alias("buckets"),
                                                 F.first("fine").alias("fine")), "near_heads")
    first = confirmed(candidates(heads.withColumn("label", F.col("fp")), False), docs, heads, text, id_column)
    groups = materialise(linked_groups(heads.select("fp", "least"), first).select("fp", F.col("component").alias("label")), "near_groups")
    second = confirmed(candidates(heads.join(groups, "fp"), True), docs, heads, text, id_column)
    return linked_groups(heads.select("fp", "least"), first.unionByName(second))


def one_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near copies, chosen as by ``simhash.one_of_each``."""
    bound_batches(docs.sparkSession)
    marked = _marked(docs, text, id_column)
    return first_of_each(docs, marked.select("id", "key", "fp"), near_groups(docs, marked, text, id_column), text, id_column)
