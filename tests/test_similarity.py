import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import quality as K
from quadrille.operators import similarity as S
from tests.conftest import rows


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1] == 0.0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    # A third of the nodes are copies of one vector: ties go to the smallest id.
    base = rng.normal(size=8)
    nodes = [(i, (base if i % 3 == 0 else rng.normal(size=8)).tolist(), str(i % 4)) for i in range(90)]
    queries = [(f"q{i}", rng.normal(size=8).tolist(), str(i % 4)) for i in range(11)]
    return nodes, queries


@pytest.mark.parametrize("block", [4096, 3])
@pytest.mark.parametrize("by_class", [False, True])
def test_nearest_by_brute_force(spark, vectors, block, by_class):
    nodes, queries = vectors
    want = []
    for q, v, c in queries:
        scored = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), n)
                        for n, w, d in nodes if not by_class or c == d)
        want += [(q, n, i + 1) for i, (_, n) in enumerate(scored[:7])]
    n = spark.createDataFrame(nodes, "node int, vector array<double>, class string").repartition(5)
    q = spark.createDataFrame(queries, "query string, vector array<double>, class string")
    assert rows(S.nearest(q, n, 7, by_class, block), "query", "node", "rank") == sorted(want, key=repr)


def test_nearest_class_agrees_with_nearest(spark, vectors):
    nodes, queries = vectors
    items = spark.createDataFrame([(n, v) for n, v, _ in nodes], "query int, vector array<double>")
    classes = spark.createDataFrame([(q, v) for q, v, _ in queries], "candidate string, vector array<double>")
    assert rows(S.nearest_class(items, classes)) == rows(S.nearest_class(items, classes, block=2))


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("http://known/1", "Bank", [1.0, 0.0]), ("http://known/2", "Bank", [0.0, 1.0]), ("http://known/3", "Fund", [0.6, 0.8])],
                                 "iri string, class string, embedding array<double>")


def resolve(spark, known, label, cls, vector):
    c = spark.createDataFrame([(label, cls, vector)], "label string, ontology_class string, embedding array<double>")
    return S.resolve_entities(c, known, "acme-bank").first()


def test_resolve_new(spark, known):
    r = resolve(spark, known, "Deutsche Bank", "http://o/Bank", None)
    assert r["is_new"] and r["confidence"] == 1.0 and r["canonical_iri"].startswith("kg://acme-bank/entity/Bank/")
    assert r["canonical_iri"] == resolve(spark, known, "Deutsche Bank", "http://o/Bank", None)["canonical_iri"]


def test_resolve_exact_iri(spark, known):
    r = resolve(spark, known, "http://known/2", "http://o/Bank", [1.0, 0.0])
    assert (r["canonical_iri"], r["is_new"], r["confidence"], r["same_as_iri"]) == ("http://known/2", False, 1.0, None)


def test_resolve_near_match_and_below_threshold(spark, known):
    near = resolve(spark, known, "Bank One", "http://o#Bank", [0.93, math.sqrt(1 - 0.93**2)])
    assert (near["canonical_iri"], near["is_new"], near["confidence"]) == ("http://known/1", False, 0.93)
    assert near["same_as_iri"].startswith("kg://acme-bank/entity/Bank/")
    assert resolve(spark, known, "Bank Two", "http://o/Bank", [0.6, -0.8])["is_new"]
    # The near neighbour is of another class.
    assert resolve(spark, known, "Fund", "http://o/Bank", [0.6, 0.8])["is_new"]


def test_string_ratio_and_merge(spark):
    df = spark.createDataFrame([("g", "https://own/abc"), ("g", "https://own/abcd"), ("g", "http://x"), ("h", "only")], "g string, iri string")
    got = {r["g"]: r for r in S.merge_confidence(df, "g", "iri", "https://own/", exact=True).collect()}
    assert got["g"]["canonical"] == "https://own/abc" and got["g"]["merged"] == 2 and 0 < got["g"]["confidence"] < 1
    assert got["h"]["confidence"] == 1.0
    pair = spark.createDataFrame([("ABCD", "bcde")], "a string, b string")
    assert pair.select(S.string_ratio("a", "b")).first()[0] == 0.75


def test_tfidf_by_brute_force(spark):
    rng = random.Random(4)
    words = ["bank", "account", "ledger", "näive", "x", "fund_1", "rate"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
    queries, candidates = [(i, text()) for i in range(8)], [(i, text()) for i in range(12)]
    token = lambda t: Counter(re.findall(r"\b\w\w+\b", t.lower()))
    want = {}
    for q, qt in queries:
        docs = [token(qt)] + [token(t) for _, t in candidates]
        df = Counter(w for d in docs for w in d)
        unit = []
        for d in docs:
            v = {w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in d.items()}
            size = math.sqrt(sum(x * x for x in v.values())) or 1
            unit.append({w: x / size for w, x in v.items()})
        for (c, _), v in zip(candidates, unit[1:]):
            s = sum(unit[0].get(w, 0) * x for w, x in v.items())
            if s:
                want[(q, c)] = s
    got = {(r["query"], r["candidate"]): r["score"] for r in S.tfidf_similarity(
        spark.createDataFrame(queries, "query int, text string"), spark.createDataFrame(candidates, "candidate int, text string")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_alignment_bounds(spark):
    drafts = spark.createDataFrame([(i,) for i in range(6)], "query int")
    scores = spark.createDataFrame([(0, "a", 0.92), (1, "a", 0.80), (2, "a", 0.65), (3, "a", 0.45), (4, "a", 0.44), (0, "b", 0.5)],
                                   "query int, candidate string, score double")
    assert rows(S.align_classes(drafts, scores), "query", "matched", "match_type", "confidence") == [
        (0, "a", "exactMatch", 0.92), (1, "a", "closeMatch", 0.8), (2, "a", "broadMatch", 0.65), (3, "a", "relatedMatch", 0.45),
        (4, None, None, 0.44), (5, None, None, 0.0)]


def test_jaccard_and_search(spark):
    df = spark.createDataFrame([("Big bank", "bank BIG fund"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(S.jaccard(F.col("a"), F.col("b"))).collect()] == [2 / 3, 0.0]
    e = spark.createDataFrame([("1", "Deutsche Bank", "Bank"), ("2", "Bank", "Bank"), ("3", "Riverbank", "Place"), ("4", "Fund", "Fund")],
                              "iri string, label string, type string")
    assert [r["iri"] for r in S.search(e, "bank").collect()] == ["2", "1", "3"]
    assert [r["iri"] for r in S.search(e, "bank", types=["Place"]).collect()] == ["3"]


def test_mapping_gate_and_statistics(spark):
    m = spark.createDataFrame([(0.9,), (0.75,), (0.7499,), (None,)], "confidence double")
    assert [r["accepted"] for r in K.accept_mappings(m).collect()] == [True, True, False, False]
    assert tuple(K.score_stats(m.limit(0)).first()) == (0.0, 0.0, 0.0, 0)


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        K.page(spark.range(3), "id", "id", limit=501)


def test_empty_catalogue_and_missing_vectors(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query string, vector array<double>")
    classes = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None)], "candidate string, vector array<double>")
    assert rows(S.nearest_class(items, classes)) == [("a", "x", 1.0)]
    assert S.nearest_class(items, classes.limit(0)).count() == 0


def test_every_embedding_of_a_candidate_counts(spark):
    found = [("name", "http://o#c", e) for e in ([1.0, 0.0], [0.0, 1.0], None)]
    candidates = spark.createDataFrame(found, "label string, ontology_class string, embedding array<double>")
    nodes = spark.createDataFrame([("http://n/1", "c", [0.1, 1.0]), ("http://n/2", "c", [-1.0, -1.0])], "iri string, class string, embedding array<double>")
    got = S.resolve_entities(candidates, nodes, "t").collect()
    assert len(got) == 1 and got[0]["canonical_iri"] == "http://n/1" and not got[0]["is_new"]
