"""SimHash fingerprints and the groups they link, by exact tiled comparison.

Distinct fingerprints are laid out in cells by the bit counts of their words.
Two fingerprints within the radius have bit counts whose differences sum to the
radius at most, so other pairs of cells are skipped; the cells that remain are
cut into tiles of bounded size and each pair of tiles is compared in full with
exclusive-or and bit counts. A pair of tiles gives a spanning forest of its
links: connection is kept, all pairs of a dense group are not.

Defined results: a null text is an empty one; a document without words has
fingerprint zero and is linked like any other; equal fingerprints (repeated
rows, copies) are linked; a null id is passed over in the choice of the
smallest id of a component, which is null when there is no other. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, map_texts, with_row
from quadrille.operators.traverse import components
from quadrille.session import materialise

SHINGLE = 3
SEED = 42
RADIUS = 2
TILE = 4096
# Shingles whose bits are unpacked at once.
HASH_BLOCK = 1 << 15


def shingle_hashes(text: str, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hashes of the shingles of a text, A-Z in lower case; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest as digest

    # On bytes, lower() and split() touch A-Z and \x20\x09-\x0D only.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    join = b" ".join
    if len(words) < shingle:
        return [digest(join(words), seed)]
    return [digest(join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]


def majority(hashes: list[int] | np.ndarray) -> int:
    """Bits that more than half of the hashes have; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASH_BLOCK):
        part = np.array(hashes[at:at + HASH_BLOCK], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit majority of the shingle hashes of a text."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprinted(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(row, fp): all columns of ``docs`` as ``row`` and its fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    def make():
        def of(texts: list[str]) -> dict[str, list]:
            fps = np.array([simhash(t, shingle, seed) for t in texts], np.uint64)
            return {"fp": fps.view(np.int64).tolist()}
        return of

    return map_texts(with_row(docs, text), make, "fp long")


def linked_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or within one).

    ``left`` and ``right`` are distinct unsigned 64-bit values. Every value with
    a link is paired with the first value of its group.
    """
    other = left if right is None else right
    values = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    label = np.arange(len(values))
    step = max(1, (1 << 20) // max(1, len(other)))
    for at in range(0, len(left), step):
        near = np.bitwise_count(left[at:at + step, None] ^ other[None, :]) <= radius
        rows, columns = np.nonzero(near)
        if right is None:
            apart = columns > rows + at
            rows, columns = rows[apart], columns[apart]
        if not len(rows):
            continue
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for row, group in zip(rows[starts] + at, np.split(columns + shift, starts[1:]), strict=True):
            found = np.unique(np.append(label[group], label[row]))
            if len(found) > 1:
                label[np.isin(label, found[1:])] = found[0]
    joined = np.flatnonzero(label != np.arange(len(values)))
    return values[joined], values[label[joined]]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, words: int | None = None) -> DataFrame:
    """(src, tgt): links that connect all distinct fingerprints within ``radius``.

    ``nodes`` has distinct values in the long column ``fp``. ``words`` says into
    how many equal words (1, 2 or 4) the bits are divided for the cells; more
    words mean smaller cells and more copies. It changes nothing in the result.
    """
    spark = nodes.sparkSession
    if words is None:
        total = nodes.count()
        words = 1 if total < 20_000 else 2 if total < 3_000_000 else 4
    width = 64 // words
    base = width + 1
    cell = F.lit(0)
    for i in range(words):
        bits = F.shiftrightunsigned("fp", i * width)
        bits = bits if words == 1 else bits.bitwiseAND((1 << width) - 1)
        cell = cell * base + F.bit_count(bits)
    placed = nodes.select("fp", cell.cast("long").alias("cell"))
    # base ** words rows at most: 83,521 with four words.
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    split = {c: -(-n // tile) for c, n in sizes.items()}
    steps = [d for d in product(range(-radius, radius + 1), repeat=words) if sum(map(abs, d)) <= radius]

    def digits(c: int) -> list[int]:
        out = []
        for _ in range(words):
            c, d = divmod(c, base)
            out.append(d)
        return out[::-1]

    pairs = []
    for c in sizes:
        at = digits(c)
        for d in steps:
            to = [x + y for x, y in zip(at, d, strict=True)]
            if all(0 <= x <= width for x in to):
                other = 0
                for x in to:
                    other = other * base + x
                if other >= c and other in sizes:
                    pairs.append((c, other, split[c], split[other]))
    grid = spark.createDataFrame(pairs, "a long, b long, sa long, sb long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    left = placed.join(grid, F.col("cell") == F.col("a")).select("fp", "a", "b", part("sa").alias("i"), each("sb").alias("j"), F.lit(0).alias("side"))
    right = placed.join(grid, F.col("cell") == F.col("b")).select("fp", "a", "b", each("sa").alias("i"), part("sb").alias("j"), F.lit(1).alias("side"))
    # Within a cell, tile pairs count once and a tile with itself has one side.
    tiles = (left.filter("a <> b OR i <= j").unionByName(right.filter("a <> b OR i < j"))
             .groupBy("a", "b", "i", "j"))

    def compare(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy()
        one, two = values[side == 0], values[side == 1]
        within = table.column("a")[0] == table.column("b")[0] and table.column("i")[0] == table.column("j")[0]
        src, tgt = linked_forest(one, None if within else two, radius)
        return pa.table({"src": src.view(np.int64), "tgt": tgt.view(np.int64)})

    return tiles.applyInArrow(compare, "src long, tgt long")


def near_groups(marked: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, component, component_id) of (id, fp) rows: a label and the smallest id of each linked group."""
    heads = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash_heads")
    return linked_groups(heads, materialise(links(heads.select("fp"), radius, tile), "simhash_links"))


def linked_groups(heads: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, component, component_id) of all ``heads`` (fp, least), grouped by the links ``found``."""
    groups = components(found.withColumn("rel", F.lit("near"))).select(F.col("node").alias("fp"), "component")
    joined = heads.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(least, "component").select("fp", "component", "component_id")


def _marked(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """(id, key, fp) of each row, written once; ``key`` is a hash of id and text."""
    key = F.xxhash64(F.col(id_column), F.col(text))
    rows = fingerprinted(docs.select(F.col(id_column).alias("id"), key.alias("key"), F.col(text).alias("text")))
    return materialise(rows.select("row.id", "row.key", "fp"), "simhash")


def simhash_components(docs: DataFrame, text: str = "text", id_column: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    marked = _marked(docs, text, id_column)
    return marked.join(near_groups(marked, radius).select("fp", "component_id"), "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each linked group: of the smallest id, and of its rows the one with the smallest hash.

    Of rows that repeat it in id and text, any one stays.
    """
    marked = _marked(docs, text, id_column)
    return first_of_each(docs, marked, near_groups(marked, radius), text, id_column)


def first_of_each(docs: DataFrame, marked: DataFrame, groups: DataFrame, text: str, id_column: str) -> DataFrame:
    """``docs`` with one row of each group, by the (id, key, fp) of its rows and the groups of each fp."""
    chosen = (marked.join(groups, "fp").filter(F.col("id").eqNullSafe(F.col("component_id")))
              .groupBy("component", "key").agg(F.count("*").alias("n"))
              .groupBy("component").agg(F.min(F.struct("key", "n")).alias("c")))
    chosen = materialise(chosen.select("c.key", "c.n"), "simhash_kept")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_column), F.col(text)).alias("key"))
    once = keyed.join(chosen.filter("n = 1").select("key"), "key", "left_semi").select("row")
    several = (keyed.join(chosen.filter("n > 1").select("key"), "key", "left_semi")
               .groupBy("key").agg(F.first("row").alias("row")).select("row"))
    return once.unionByName(several).select("row.*")
