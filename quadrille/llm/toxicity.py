"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows chooses the terms (by chi-squared of presence
against the label) and serves as the examples; document frequencies are counted
over all documents. The examples are stored as an inverted index in blocks:
per block the posting lists of its terms, and per term the largest weight in
the block. The largest weights bound the cosine any example of the block can
reach, so a document visits blocks in the order of that bound and leaves out
those that cannot change its k nearest. The votes of the nearest, weighted by
cosine, are calibrated on labelled rows that are not in the index.

What travels to the tasks is bounded by ``examples`` and ``terms``.

Defined results: a null text is an empty one; a text without any chosen term
has no neighbours and gets the calibrated prior; rows with null labels or ids
teach nothing, of several labels of one id the largest counts; repeated rows get equal scores.
Without both labels in the sample every score is the share of label 1 (0.5 if
there is no labelled row). An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrille.llm.common import bound_batches, plain, shared, with_row
from quadrille.session import materialise

# Labelled rows used to fit: the documented bound of the sample.
SAMPLE = 10_000
# Terms kept; sample documents and chi-squared (one in a thousand by chance) a term needs.
TERMS, LEAST_DOCUMENTS, LEAST_CHI = 256, 5, 10.8
BLOCK = 256
NEIGHBOURS = 15
# Weight of the prior in a vote, in units of cosine.
PRIOR = 0.5

# Letters of any alphabet stay; A-Z to a-z, other ASCII to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str) -> Counter:
    return Counter(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())


@dataclass
class Block:
    terms: np.ndarray       # numbers of the terms that have postings here
    postings: np.ndarray    # terms x examples
    first: int              # number of the block's first example


class BlockMaxIndex:
    """Unit vectors of examples as posting lists by block, with the largest weight of each."""

    def __init__(self, vectors: np.ndarray, block: int = BLOCK):
        # Examples with the same strongest term lie together, which makes the bounds tight.
        self.order = np.lexsort((-vectors.max(axis=1), vectors.argmax(axis=1))) if len(vectors) else np.empty(0, int)
        sorted_vectors = vectors[self.order]
        self.blocks: list[Block] = []
        for at in range(0, len(vectors), block):
            part = sorted_vectors[at:at + block]
            present = np.flatnonzero(part.any(axis=0))
            self.blocks.append(Block(present, np.ascontiguousarray(part[:, present].T), at))
        self.largest = np.zeros((vectors.shape[1], len(self.blocks)))
        for i, b in enumerate(self.blocks):
            self.largest[b.terms, i] = b.postings.max(axis=1)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, example) of the k nearest of each unit query; cosine 0 and example -1 where there is none.

        Ties go to the smaller example number.
        """
        best = np.zeros((len(queries), k))
        which = np.full((len(queries), k), -1)
        bounds = queries @ self.largest
        for i in np.argsort(-bounds.mean(axis=0), kind="stable") if len(queries) else []:
            block = self.blocks[i]
            # A hair of slack for rounding: equal cosines must be seen for their tie to be decided.
            open_ = np.flatnonzero((bounds[:, i] > 0) & (bounds[:, i] >= best[:, -1] - 1e-9))
            if not len(open_):
                continue
            scores = queries[np.ix_(open_, block.terms)] @ block.postings
            names = self.order[block.first:block.first + scores.shape[1]]
            merged = np.concatenate([best[open_], np.round(scores, 12)], axis=1)
            labels = np.concatenate([which[open_], np.broadcast_to(names, scores.shape)], axis=1)
            labels = np.where(merged > 0, labels, -1)
            take = np.lexsort((labels, -merged), axis=1)[:, :k]
            best[open_] = np.take_along_axis(merged, take, axis=1)
            which[open_] = np.take_along_axis(labels, take, axis=1)
        return best, which


@dataclass
class Model:
    terms: dict[bytes, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    prior: float
    slope: float = 1.0
    offset: float = 0.0

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.terms)))
        for row, text in zip(out, texts, strict=True):
            for term, n in terms_of(text).items():
                at = self.terms.get(term)
                if at is not None:
                    row[at] = n
        return unit(out, self.idf)

    def votes(self, vectors: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cosine, which = self.index.search(vectors, k)
        label = np.where(which >= 0, self.labels[which] if len(self.labels) else 0, 0)
        raw = ((cosine * label).sum(axis=1) + PRIOR * self.prior) / (cosine.sum(axis=1) + PRIOR)
        return raw, cosine, which

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * logit(raw) + self.offset)))


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of term counts, with logarithmic term frequency."""
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norms = np.sqrt((weights ** 2).sum(axis=1, keepdims=True))
    return weights / np.where(norms > 0, norms, 1)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with smoothed targets."""
    positive, negative = y.sum(), len(y) - y.sum()
    if not positive or not negative:
        return 1.0, 0.0
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - target) + 1e-6 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), float(w[1])


def _presence(sample: DataFrame, least: int, terms: int) -> list[bytes]:
    """The terms with the largest chi-squared between presence and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                seen[label].update(set(terms_of(text)))
        words = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(words), 10_000):
            part = words[at:at + 10_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.binary()), "n0": pa.array([seen[0][w] for w in part], pa.int64()),
                                              "n1": pa.array([seen[1][w] for w in part], pa.int64())})

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    a, b = totals.get(0, 0), totals.get(1, 0)
    if not a or not b:
        return []
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = float(a + b)
    both = n0 + n1
    chi = n * F.pow(n1 * (a - n0) - n0 * (b - n1), 2) / (both * (n - both + 1) * a * b)
    ranked = (sample.select("text", "label").mapInArrow(run, "term binary, n0 long, n1 long")
              .groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
              .filter((F.col("n0") + F.col("n1") >= least) & (chi >= LEAST_CHI)).orderBy(chi.desc(), "term").limit(terms))
    return [bytes(r["term"]) for r in ranked.collect()]


def _frequencies(docs: DataFrame, text: str, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total[-1] += 1
                total[[terms[w] for w in set(t.encode("utf-8", "surrogatepass").translate(_FOLD).split()) if w in terms]] += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(len(total)), pa.int64()), "n": pa.array(total)})

    rows = docs.select(plain(text).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(terms) + 1, np.int64)
    for r in rows:
        counts[r["term"]] = r["n"]
    return counts[:-1], int(counts[-1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "toxic",
        sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Learn from the labelled rows; ``sample`` bounds how many, chosen by a hash of their id."""
    bound_batches(docs.sparkSession)
    known = (labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"))
             .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label")))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    examples = (docs.select(F.col(id_column).alias("id"), plain(text).alias("text"))
                .join(F.broadcast(known), "id").groupBy("id", "label").agg(F.max("text").alias("text")))
    examples = materialise(examples, "labelled")
    chosen = {t: i for i, t in enumerate(_presence(examples, LEAST_DOCUMENTS, terms))}
    frequency, total = _frequencies(docs, text, chosen)
    idf = np.log((1 + total) / (1 + frequency))
    model = Model(chosen, idf, BlockMaxIndex(np.zeros((0, len(chosen)))), np.empty(0, np.int64), np.empty(0, np.int64), 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = model.vectors(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([v.tobytes() for v in vectors], pa.binary())],
                                             names=["id", "label", "vector"])

    schema = StructType([examples.schema["id"], *StructType.fromDDL("label int, vector binary").fields])
    # sample x terms numbers at most.
    rows = examples.select("id", "label", "text").mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: r["id"])
    if not rows:
        return model
    y = np.array([r["label"] for r in rows], np.int64)
    x = np.stack([np.frombuffer(r["vector"]) for r in rows])
    model.prior = float(y.mean())
    held = np.arange(len(rows)) % 5 == 0
    if not chosen or len(set(y[~held])) < 2:
        return model
    model.ids, model.labels = np.array([r["id"] for r in rows])[~held], y[~held]
    model.index = BlockMaxIndex(x[~held])
    raw, _, _ = model.votes(x[held])
    model.slope, model.offset = logistic_fit(logit(raw), y[held])
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score, neighbours): all columns of ``docs`` as ``row``; neighbours are the evidence, nearest first."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = with_row(docs, text)
    sent = shared(spark, model)
    schema = StructType([rows.schema["row"], *StructType.fromDDL(
        "score double, neighbours array<struct<id:string,label:int,cosine:double>>").fields])
    kind = pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw, cosine, which = m.votes(m.vectors(part.column("text").to_pylist()))
                near = [[{"id": str(m.ids[w]), "label": int(m.labels[w]), "cosine": float(c)} for c, w in zip(cs, ws, strict=True) if w >= 0]
                        for cs, ws in zip(cosine, which, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(m.calibrated(raw), pa.float64()), pa.array(near, kind)],
                                                 names=["row", "score", "neighbours"])

    return rows.mapInArrow(run, schema)
