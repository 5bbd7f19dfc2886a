"""Ontology-grounded retrieval: seeds, neighbourhoods, hyperedges, ranking.

A hyperedge is kept as its rows and a summary, never as one array: a class may
hold a third of the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.similarity import nearest
from quadrille.operators.traverse import traverse
from quadrille.vocab import TYPE

MAX_SEEDS = 5


def first_seeds(seeds: DataFrame, limit: int = MAX_SEEDS) -> DataFrame:
    """The first seeds of each question: (question, seed) by ``position``."""
    w = Window.partitionBy("question").orderBy("position", "seed")
    return seeds.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).select("question", "seed")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(question, s, p, o) within ``depth`` hops of the question's seeds."""
    if not 1 <= depth <= 4:
        raise ValueError("depth must be between 1 and 4")
    starts = first_seeds(seeds)
    walk = traverse(edges, starts.select("seed").distinct(), depth)
    # Seeds shared by questions are walked once.
    return (starts.join(walk, "seed")
            .select("question", F.col("src").alias("s"), F.col("rel").alias("p"), F.col("tgt").alias("o")).distinct())


def vector_candidates(questions: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """2k nearest nodes per question: (question, s, score)."""
    found = nearest(questions.select(F.col("question").alias("query"), "vector"), nodes, 2 * k)
    return found.select(F.col("query").alias("question"), F.col("node").alias("s"), "score")


def with_class(rows: DataFrame, quads: DataFrame) -> DataFrame:
    """Class of each row's subject, ``owl:Thing`` where none is stated."""
    types = (quads.filter(F.col("predicate") == TYPE).groupBy(F.col("subject").alias("s"))
             .agg(F.min("object").alias("class")))
    return rows.join(types, "s", "left").withColumn("class", F.coalesce("class", F.lit("owl:Thing")))


def _content_sum(*columns: str) -> Column:
    """Order-free digest of distinct rows: the sum of 60-bit hashes."""
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(c, F.lit("")) for c in columns]), 256)
    return F.sum(F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)"))


def hyperedges(rows: DataFrame, by: tuple[str, ...] = ("question",), length: int = 64) -> DataFrame:
    """Summary per question and class: triples, entities and a content id.

    The id is a hash of the set of triples, whatever their order; it is summed
    row by row, so no group is ever sorted or held in one place.
    """
    distinct = rows.select(*by, "class", "s", "p", "o").distinct()
    return distinct.groupBy(*by, "class").agg(
        F.count("*").alias("triples"), F.count_distinct("s").alias("entities"), _content_sum("s", "p", "o").alias("_sum")
    ).withColumn("id", F.concat(F.lit("he_"), F.substring(
        F.sha2(F.concat_ws(":", F.col("triples").cast("string"), F.col("_sum").cast("string")), 256), 1, length))).drop("_sum")


def rank_hyperedges(edges: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """Top k hyperedges per question; ``scores``: (question, class, score), missing counts as 0."""
    if not 1 <= k <= 20:
        raise ValueError("k must be between 1 and 20")
    w = Window.partitionBy("question").orderBy(F.desc("score"), "class")
    return (edges.join(scores, ["question", "class"], "left")
            .withColumn("score", F.coalesce("score", F.lit(0.0)))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def overlap_scores(rows: DataFrame, question_tokens: DataFrame, value: str = "o") -> DataFrame:
    """Largest token overlap of a hyperedge's values with the question.

    ``question_tokens``: (question, tokens array). The maximum is a map-side
    aggregate over the rows.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower(value), r"\s+"), lambda x: x != ""))
    joined = rows.join(question_tokens, "question").withColumn("_t", tokens)
    union = F.size(F.array_union("_t", "tokens"))
    score = F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("_t", "tokens")) / union)
    return joined.groupBy("question", "class").agg(F.max(score).alias("score"))
