"""Stored indexes for vectors and texts beside exhaustive search."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from quadrille import session
from quadrille.operators import similarity as S
from quadrille.operators import text_index as I
from quadrille.operators import vector_index as X
from tests.conftest import rows


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 12))
    hot = centres[0] / np.linalg.norm(centres[0])
    # A third are copies of one vector; one has no length, one is missing.
    nodes = [(i, (hot if i % 3 == 0 else centres[i % 25] + 0.25 * rng.normal(size=12)).tolist(), ("3", "b/c", None)[i % 3]) for i in range(1500)]
    nodes += [(9000, [0.0] * 12, "3"), (9001, None, "3")]
    queries = [(f"q{i}", (centres[i % 25] + 0.3 * rng.normal(size=12)).tolist(), ("3", "b/c", None, "none of these")[i % 4]) for i in range(40)]
    return nodes, queries


NODE, QUERY = "node int, vector array<double>, class string", "query string, vector array<double>, class string"


def ranked(df):
    return rows(df, "query", "node", "score", "rank")


def test_index_is_exact_in_two_rounds(spark, tmp_path, clustered, monkeypatch):
    nodes, queries = spark.createDataFrame(clustered[0], NODE), spark.createDataFrame(clustered[1], QUERY)
    # Blocks so small that the hot cell and the crowded queries are cut.
    monkeypatch.setattr(X, "NODE_BLOCK", 90)
    monkeypatch.setattr(X, "QUERY_BLOCK", 7)
    index = X.build(nodes, str(tmp_path / "index"))
    assert ranked(X.search(queries, index, 6, probes=1, exact=True)) == ranked(S.nearest(queries, nodes, 6))
    known = nodes.fillna("?", ["class"])
    same = ranked(S.nearest(queries.fillna("?", ["class"]), known, 6, by_class=True))
    assert ranked(X.search(queries, index, 6, by_class=True, probes=1, exact=True)) == same
    again = X.open_index(spark, str(tmp_path / "index"))
    assert again.nodes.count() == 1501 and again.sizes.agg({"rows": "sum"}).first()[0] == 1501
    assert X.search(queries.limit(0), again, 3).count() == 0


def test_approximate_search_visits_few_cells_with_high_recall(spark, tmp_path, clustered):
    nodes, queries = spark.createDataFrame(clustered[0], NODE), spark.createDataFrame(clustered[1], QUERY)
    index = X.build(nodes, str(tmp_path / "index"))
    centres, probes = index.centroids()
    assert probes < len(centres) / 2
    found = X.search(queries, index, 10)
    got = X.recall(found, S.nearest(queries, nodes, 10)).first()
    assert got["queries"] == 40 and got["wanted"] == 400 and got["recall"] >= 0.9


def test_vectors_added_later_are_found(spark, tmp_path, clustered):
    nodes, queries = spark.createDataFrame(clustered[0], NODE), spark.createDataFrame(clustered[1], QUERY)
    index = X.build(nodes.filter("node % 2 = 0"), str(tmp_path / "index"), cells=9)
    X.add(index, nodes.filter("node % 2 = 1"))
    assert ranked(X.search(queries, index, 5, exact=True)) == ranked(S.nearest(queries, nodes, 5))


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], NODE)
    index = X.build(none, str(tmp_path / "index"))
    assert X.search(spark.createDataFrame([("q", [1.0, 0.0], "c")], QUERY), index, 3, exact=True).count() == 0


def test_recall_on_the_supplied_vectors(spark, tmp_path):
    from quadrille.plans.registry import QUERIES
    import __spark_entry__

    __spark_entry__.queries()
    assert tuple(QUERIES["e2_vector_index_recall"](spark, "/root/testdata/sf0.1").first()) == (40, True)


def brute_scores(queries, candidates):
    token = lambda t: Counter(re.findall(r"\w\w+", (t or "").lower()))
    out = {}
    for q, qt in queries:
        docs = [token(qt)] + [token(t) for _, t in candidates]
        df = Counter(w for d in docs for w in d)
        unit = []
        for d in docs:
            v = {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in d.items()}
            size = math.sqrt(sum(x * x for x in v.values())) or 1
            unit.append({w: x / size for w, x in v.items()})
        for (c, _), v in zip(candidates, unit[1:], strict=True):
            s = sum(unit[0].get(w, 0) * x for w, x in v.items())
            if s:
                out.setdefault(q, []).append((-round(s, 9), c))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    rare = [f"w{i}" for i in range(120)]
    # Every text has stop words; a third of the candidates are one text.
    line = lambda n: " ".join(["the", "of", "the"] + [rng.choice(rare) for _ in range(n)] + ["and"] * rng.randrange(3))
    candidates = [(i, "the of the w1 w2 w3" if i % 3 == 0 else line(rng.randrange(1, 9))) for i in range(240)] + [(900, None), (901, "")]
    queries = [(i, line(rng.randrange(0, 7))) for i in range(25)] + [(100, "the of"), (101, "unknown words"), (102, None), (103, "w1 w2 w3 the")]
    return queries, candidates


@pytest.mark.parametrize("k", [1, 4, 300])
def test_top_k_texts_by_brute_force(spark, texts, k):
    queries, candidates = texts
    want = sorted((q, c, i + 1) for q, found in brute_scores(queries, candidates).items() for i, (_, c) in enumerate(sorted(found)[:k]))
    q = spark.createDataFrame(queries, "query int, text string")
    c = spark.createDataFrame(candidates, "candidate int, text string")
    assert rows(I.top_k(q, c, k), "query", "candidate", "rank") == sorted(want, key=repr)


@pytest.mark.parametrize("sent", [0, 200_000])
@pytest.mark.parametrize("k", [1, 4, 300])
def test_top_k_texts_by_thresholds_and_dealt_lists(spark, texts, k, sent, monkeypatch):
    monkeypatch.setattr(I, "DIRECT", 0)
    monkeypatch.setattr(I, "LISTS_SENT", sent)
    test_top_k_texts_by_brute_force(spark, texts, k)


@pytest.mark.parametrize("sent", [0, 200_000])
def test_texts_are_dealt_by_the_pairs_they_make(spark, texts, sent, monkeypatch):
    monkeypatch.setattr(I, "LISTS_SENT", sent)
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    queries, candidates = texts
    q, c = spark.createDataFrame(queries, "query int, text string"), spark.createDataFrame(candidates, "candidate int, text string")
    best = I.top_k(q, c, 3)
    every = brute_scores(queries, candidates)
    assert best.count() == sum(min(3, len(found)) for found in every.values())
    # Some 6,000 pairs; three tasks at most had them all, whatever their number.
    assert best.rdd.getNumPartitions() >= sum(map(len, every.values())) / 200


def test_all_scores_are_dealt_by_their_number(spark, texts, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    queries, candidates = texts
    got = S.tfidf_similarity(spark.createDataFrame(queries, "query int, text string"), spark.createDataFrame(candidates, "candidate int, text string"))
    want = sorted((q, c, -s) for q, found in brute_scores(queries, candidates).items() for s, c in found)
    assert rows(got.selectExpr("query", "candidate", "round(score, 9) + 0.0 AS score")) == [
        (q, c, pytest.approx(s, abs=2e-9)) for q, c, s in sorted(want, key=repr)]
    # One task before.
    assert got.rdd.getNumPartitions() >= len(want) / 200


def test_scores_are_made_once_for_an_alignment(spark):
    drafts = spark.createDataFrame([("a",), ("b",), ("none",), ("a",)], "query string")
    scores = spark.range(400).selectExpr(
        "if(id % 2 = 0, 'a', 'b') AS query", "concat('c', id) AS candidate",
        "if(id % 2 = 1, null, if(id IN (20, 100, 300), 0.9 + id * 1e-13, 0.5)) AS score")
    got = S.align_classes(drafts, scores)
    # Equal at 9 places: the smallest candidate (of strings) and the best score.
    assert rows(got.selectExpr("query", "matched", "confidence = 0.9 + 300 * 1e-13 AS best", "match_type")) == [
        ("a", "c100", True, "closeMatch")] * 2 + [("b", None, False, None), ("none", None, False, None)]
    # Read twice before, so that all texts were scored twice.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_lists_of_stop_words_are_not_read(spark, texts):
    queries, candidates = texts
    index = I.index_texts(spark.createDataFrame(candidates, "candidate int, text string"))
    queries = [(q, t) for q, t in queries if t and len(t.split()) > 6]
    weights = I._weights(spark.createDataFrame(queries, "query int, text string"), index)
    every = sum(map(len, brute_scores(queries, candidates).values()))
    assert I.open_pairs(weights, index, 1).count() < every / 5


def test_empty_text_index(spark):
    q = spark.createDataFrame([(1, "some words")], "query int, text string")
    assert I.top_k(q, spark.createDataFrame([], "candidate int, text string"), 2).count() == 0
    assert I.top_k(q.limit(0), q.withColumnRenamed("query", "candidate"), 2).count() == 0


def test_pairs_with_cells_are_bounded():
    # Every row of a batch may visit every cell, each time with its vector.
    batches = [pd.DataFrame({"query": range(n)}) for n in (10_000, 0, 3)]
    parts = list(X._slices(iter(batches), X.MAX_CELLS))
    assert max(len(p) for p in parts) * X.MAX_CELLS <= X.PAIRS
    assert pd.concat(parts)["query"].tolist() == [*range(10_000), *range(3)]
    assert [len(p) for p in X._slices(iter(batches), 10 * X.PAIRS)] == [1] * 10_003
