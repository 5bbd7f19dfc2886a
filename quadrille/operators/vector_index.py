"""A stored vector index: coarse centroids, one cell each, probed by a join.

``build`` fits the centroids (spherical k-means) on a bounded sample, puts every
vector into the cell of its nearest centroid and writes three tables:

- ``nodes`` (node, vector, class, cell), partitioned by class, sorted by cell, so that a search
  of one class opens one folder and reads few row groups of it;
- ``centroids`` (cell, vector, probes), at most ``MAX_CELLS`` rows: they travel with the tasks;
- ``sizes`` (class, cell, rows, radius), one row per filled cell and load: the radius is the
  largest angle between the centroid and a member.

``search`` sends each query to its nearest cells and scores it there against the
members, exactly. Cells with many members are cut into blocks and cells with many queries into
query blocks by the counts in ``sizes`` and of the queries, so a cell that holds
a third of all vectors is the work of many tasks. With ``exact`` a second round
visits every cell that could still hold a better vector: one whose
centroid is no farther from the query than the angle of its kth score plus the
cell's radius. The answer is then that of ``similarity.nearest``.

Vectors without length are in the first cell and score 0; null vectors are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.similarity import NODE_BLOCK, QUERY_BLOCK, _score, _unit
from quadrille.session import materialise

MAX_CELLS = 4096
# Vectors that fit the centroids: those of the smallest hashes.
SAMPLE = 65_536
ROUNDS = 12
# ``probes``, the cells an approximate search visits, is set when the index is built: so many
# as hold this share of the ten nearest vectors of some of the sample's own.
RECALL, NEIGHBOURS, TRIALS = 0.95, 10, 256
# Angles are compared with some room for rounding of scores to 6 places.
SLACK = 1e-5
# Pairs of a vector and a cell that a task holds at once; each may become a row with the vector.
PAIRS = 32_768


@dataclass(frozen=True)
class Index:
    """The tables of a stored index."""

    path: str
    spark: SparkSession

    @property
    def nodes(self) -> DataFrame:
        # The schema is kept apart, as an index of nothing has no files, and classes are text whatever they look like.
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/nodes")

    @property
    def sizes(self) -> DataFrame:
        """Rows and radius of each filled cell, over all loads."""
        stored = self.spark.read.parquet(f"{self.path}/sizes")
        return stored.groupBy("class", "cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))

    def centroids(self) -> tuple[np.ndarray, int]:
        """At most MAX_CELLS unit vectors in the order of their cells, and how many of them a search visits."""
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").toPandas()
        return np.array(rows["vector"].tolist(), dtype="float64").reshape(len(rows), -1), int(rows["probes"].iloc[0])


def fit(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means, started from vectors far from each other."""
    cells = min(cells, len(vectors))
    rng = np.random.default_rng(0)
    chosen = [int(rng.integers(len(vectors)))]
    best = vectors @ vectors[chosen[0]]
    while len(chosen) < cells:
        weight = np.maximum(1 - best, 0)
        total = weight.sum()
        if total <= 1e-9:
            break
        chosen.append(int(np.searchsorted(np.cumsum(weight), rng.random() * total).clip(0, len(vectors) - 1)))
        best = np.maximum(best, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(vectors, max(1, len(vectors) // 8192))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def needed_probes(vectors: np.ndarray, centres: np.ndarray) -> int:
    """How many of the nearest cells hold RECALL of the neighbours of some of the vectors."""
    asked = vectors[:TRIALS]
    scores = asked @ vectors.T
    k = min(NEIGHBOURS, len(vectors))
    found = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    cell_of = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(vectors, max(1, len(vectors) // 8192))])
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(place, cell_of[found], axis=1)
    return int(np.quantile(ranks, RECALL, method="higher")) + 1


def _cosines(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    """An index built from no vectors has one cell without a direction."""
    return _unit(vectors) @ centres.T if centres.shape[1] else np.zeros((len(vectors), len(centres)))


def _slices(batches: Iterator[pd.DataFrame], cells: int) -> Iterator[pd.DataFrame]:
    """Rows in slices of at most PAIRS pairs with the cells, one row at least."""
    step = max(1, PAIRS // max(1, cells))
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.iloc[at : at + step]


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _assigned(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    """``nodes`` with their cell and their angle to its centroid."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*nodes.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches, len(shared.value)):
            cosines = _cosines(part["vector"], shared.value)
            cell = cosines.argmax(axis=1)
            yield part.assign(cell=cell.astype("int32"), angle=_angles(cosines[np.arange(len(cell)), cell]))

    return nodes.mapInPandas(run, schema)


def _classed(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", "vector", _class(nodes).alias("class")).filter("vector IS NOT NULL")


def _class(df: DataFrame) -> Column:
    """A folder name that reads back as the text it was, whatever the class."""
    cls = F.col("class").cast("string") if "class" in df.columns else F.lit(None)
    return F.coalesce(F.concat(F.lit("="), cls), F.lit("none"))


def add(index: Index, nodes: DataFrame) -> Index:
    """Put more vectors into a stored index; its centroids stay, radii and counts grow."""
    placed = materialise(_assigned(_classed(nodes), index.centroids()[0]), "cells")
    (placed.drop("angle").repartition("class", "cell").sortWithinPartitions("class", "cell")
     .write.mode("append").partitionBy("class").parquet(f"{index.path}/nodes"))
    (placed.groupBy("class", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"))
     .write.mode("append").parquet(f"{index.path}/sizes"))
    return index


def build(nodes: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Fit centroids and store every vector of ``nodes`` (node, vector and, if wanted, class) under ``path``.

    ``cells`` is the square root of the number of vectors by default, at most MAX_CELLS;
    ``sample`` bounds what is collected to fit the centroids, and nothing else.
    """
    spark = nodes.sparkSession
    known = _classed(nodes)
    count = known.count()
    cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(count))))
    some = known.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toPandas()
    unit = _unit(some["vector"]) if len(some) else np.zeros((1, 0))
    unit = unit[np.abs(unit).sum(axis=1) > 0] if np.any(unit) else unit[:1]
    centres = fit(unit, cells)
    probes = needed_probes(unit, centres)
    rows = [(i, [float(x) for x in v], probes) for i, v in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, vector array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    empty = known.limit(0)
    empty.select("node", "vector", F.lit(0).alias("cell"), "class").write.mode("overwrite").parquet(f"{path}/schema")
    empty.select("node", "vector", F.lit(0).alias("cell"), "class").write.mode("overwrite").partitionBy("class").parquet(f"{path}/nodes")
    empty.select("class", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("radius")).write.mode("overwrite").parquet(f"{path}/sizes")
    return add(Index(path, spark), nodes)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(path, spark)


def _probes(queries: DataFrame, centres: np.ndarray, probes: int, radii: np.ndarray | None) -> DataFrame:
    """Queries beside the cells they visit: the nearest ``probes``, or, given radii, the others that could hold better than ``floor``."""
    shared = queries.sparkSession.sparkContext.broadcast((centres, radii))
    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, radii = shared.value
        for part in _slices(batches, len(centres)):
            cosines = _cosines(part["vector"], centres)
            order = np.argsort(-cosines, axis=1, kind="stable")
            visit = np.zeros(cosines.shape, bool)
            np.put_along_axis(visit, order[:, :probes], True, axis=1)
            if radii is not None:
                # The kth score so far, or no score at all, which every cell can better.
                reach = np.where(part["floor"].isna(), np.pi, _angles(part["floor"].fillna(-1).to_numpy() - SLACK))
                visit = ~visit & (_angles(cosines) <= reach[:, None] + radii[None, :] + SLACK)
            row, cell = np.nonzero(visit)
            yield part.iloc[row].assign(cell=cell.astype("int32"))

    return queries.mapInPandas(run, schema)


def _visited(probed: DataFrame, index: Index, k: int, keys: list[str]) -> DataFrame:
    """The best k of each query in each block of the cells it visits."""
    cells = [*keys, "cell"]
    probed = materialise(probed.select("query", "vector", *cells), "probes")
    blocks = lambda rows, size: F.ceil(F.col(rows) / size).cast("int")
    asked = probed.groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))
    sizes = index.sizes.groupBy(*cells).agg(F.sum("rows").alias("rows"))
    plan = asked.join(sizes, cells).select(*cells, blocks("n", QUERY_BLOCK).alias("q_blocks"), blocks("rows", NODE_BLOCK).alias("n_blocks"))
    plan = materialise(plan, "visits")

    def dealt(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
        """A block of its own by hash, and a copy for every block of the other side."""
        own_block = F.pmod(F.xxhash64(key), F.col(f"{own}_blocks")).cast("int").alias(f"_{own}")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"_{other}")
        return df.join(plan, cells).select(*df.columns, own_block, copies)

    group = [*cells, "_q", "_n"]
    left = dealt(probed, "q", "n", "query").groupBy(*group)
    right = dealt(index.nodes.select("node", "vector", *cells), "n", "q", "node").groupBy(*group)
    schema = T.StructType([T.StructField("query", probed.schema["query"].dataType),
                           T.StructField("node", index.nodes.schema["node"].dataType), T.StructField("score", T.DoubleType())])

    def cell(q: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        if q.empty or n.empty:
            return pd.DataFrame({"query": [], "node": [], "score": []})
        return _score(q, _unit(q["vector"]), n, k, False)

    return left.cogroup(right).applyInPandas(cell, schema)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int, by_class: bool = False, probes: int | None = None, exact: bool = False) -> DataFrame:
    """The k nearest vectors of each query in the cells it visits: (query, node, score, rank), as ``similarity.nearest`` returns.

    ``queries``: ``query``, ``vector`` (and ``class``). With ``exact`` no nearer vector is missed;
    without it ``probes`` cells are visited, as many as the index was tuned to by default.
    """
    keys = ["class"] if by_class else []
    cls = [_class(queries).alias("class")] if by_class else []
    q = queries.select("query", "vector", *cls).filter("vector IS NOT NULL")
    centres, tuned = index.centroids()
    probes = probes or tuned
    first = _visited(_probes(q, centres, probes, None), index, k, keys)
    if not exact:
        return _ranked(first, k)
    first = materialise(first, "first")
    radius = {r["cell"]: r["radius"] for r in index.sizes.groupBy("cell").agg(F.max("radius").alias("radius")).collect()}
    radii = np.array([radius.get(i, -2 * np.pi) for i in range(len(centres))])
    floor = _ranked(first, k).filter(F.col("rank") == k).select(F.col("query").alias("_q"), F.col("score").alias("floor"))
    again = q.join(floor, F.col("query") == F.col("_q"), "left").select(*q.columns, "floor")
    second = _visited(_probes(again, centres, probes, radii), index, k, keys)
    return _ranked(first.unionByName(second), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """How many of the exact neighbours were found: (queries, wanted, hits, recall). A found node as near as the kth counts."""
    last = exact.groupBy("query").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("wanted"))
    hits = (found.join(last, "query").filter(F.col("score") >= F.col("least")).groupBy("query")
            .agg(F.count(F.lit(1)).alias("hits")))
    return (last.join(hits, "query", "left").agg(
        F.count(F.lit(1)).alias("queries"), F.sum("wanted").alias("wanted"),
        F.coalesce(F.sum(F.least("hits", "wanted")), F.lit(0)).alias("hits"))
        .withColumn("recall", F.col("hits") / F.col("wanted")))
