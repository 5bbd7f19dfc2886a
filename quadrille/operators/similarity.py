"""Vector and text similarity, entity resolution and alignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille import vocab
from quadrille.functions.columns import local_name
from quadrille.operators.triples import explode_quads, quad

RESOLUTION_THRESHOLD = 0.85
# Lower bounds of the match types, tested in this order.
MATCH_TYPES = ((0.92, "exactMatch"), (0.80, "closeMatch"), (0.65, "broadMatch"), (0.45, "relatedMatch"))

# At most this many query vectors travel with the tasks (8 MB at 256 dimensions).
QUERY_BLOCK = 4096
# Nodes per block when both sides are blocked.
NODE_BLOCK = 65536
# Scores held at once by one task.
SCORE_CELLS = 4_000_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; zero when either has no length."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), zero, lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, zero).otherwise(dot(a, b) / norms)


def _unit(vectors: Sequence[Sequence[float]]) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype="float64") for v in vectors], dtype="float64")
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["query", "score", "node"], ascending=[True, False, True], kind="stable")
    return frame.groupby("query", sort=False).head(k)


def _score(queries: pd.DataFrame, unit: np.ndarray, nodes: pd.DataFrame, k: int, by_class: bool) -> pd.DataFrame:
    """The k best nodes per query, ties by smallest node; never all pairs at once."""
    kept = []
    step = max(1, SCORE_CELLS // max(1, len(queries)))
    ids = queries["query"].to_numpy()
    for at in range(0, len(nodes), step):
        part = nodes.iloc[at : at + step]
        scores = np.round(unit @ _unit(part["vector"]).T, 6)
        if by_class:
            same = queries["class"].to_numpy()[:, None] == part["class"].to_numpy()[None, :]
            scores = np.where(same, scores, -np.inf)
        if scores.shape[1] > k:
            cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
            rows, cols = np.nonzero((scores >= cut) & np.isfinite(scores))
        else:
            rows, cols = np.nonzero(np.isfinite(scores))
        kept.append(pd.DataFrame({"query": ids[rows], "node": part["node"].to_numpy()[cols], "score": scores[rows, cols]}))
        if len(kept) > 1:
            kept = [_best(pd.concat(kept), k)]
    return _best(kept[0], k) if kept else pd.DataFrame({"query": [], "node": [], "score": []})


def nearest(queries: DataFrame, nodes: DataFrame, k: int, by_class: bool = False, query_block: int = QUERY_BLOCK
            ) -> DataFrame:
    """Exact k nearest nodes by cosine: (query, node, score, rank).

    ``queries``: ``query``, ``vector`` (and ``class``); ``nodes``: ``node``,
    ``vector`` (and ``class``). With ``by_class`` only nodes of the query's
    class count. Scores are rounded to 6 places and ties go to the smallest
    node.

    Up to ``query_block`` queries travel with the tasks: nodes are read where
    they lie and each task returns at most k rows per query. More queries than
    that are laid out with the nodes on a grid of bounded blocks, one task per
    cell, again returning only the best k.
    """
    columns = ["class"] if by_class else []
    q = queries.select("query", "vector", *columns).filter("vector IS NOT NULL")
    n = nodes.select("node", "vector", *columns).filter("vector IS NOT NULL")
    schema = T.StructType([T.StructField("query", q.schema["query"].dataType),
                           T.StructField("node", n.schema["node"].dataType), T.StructField("score", T.DoubleType())])
    # The size check: never more than one block reaches the driver.
    head = q.limit(query_block + 1).toPandas()
    if len(head) <= query_block:
        if head.empty:
            partial = q.sparkSession.createDataFrame([], schema)
        else:
            shared = q.sparkSession.sparkContext.broadcast((head.drop(columns="vector"), _unit(head["vector"])))

            def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                frame, unit = shared.value
                best = None
                for batch in batches:
                    found = _score(frame, unit, batch, k, by_class)
                    best = found if best is None else _best(pd.concat([best, found]), k)
                if best is not None:
                    yield best

            partial = n.mapInPandas(local, schema)
    else:
        partial = _grid(q, n, k, by_class, query_block, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _grid(q: DataFrame, n: DataFrame, k: int, by_class: bool, query_block: int, schema) -> DataFrame:
    rows = -(-q.count() // query_block)
    cols = -(-n.count() // NODE_BLOCK)
    q = (q.withColumn("_r", F.pmod(F.xxhash64("query"), F.lit(rows)))
         .withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))))
    n = (n.withColumn("_c", F.pmod(F.xxhash64("node"), F.lit(cols)))
         .withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query": [], "node": [], "score": []})
        return _score(left, _unit(left["vector"]), right, k, by_class)

    keys = ["_r", "_c"]
    left = q.withColumns({c: F.col(c).cast("long") for c in keys}).groupBy(*keys)
    right = n.withColumns({c: F.col(c).cast("long") for c in keys}).groupBy(*keys)
    return left.cogroup(right).applyInPandas(cell, schema)


def nearest_class(items: DataFrame, classes: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """Best class of every item: (query, candidate, score), ties to the smallest.

    ``items``: ``query``, ``vector``; ``classes``: ``candidate``, ``vector``. Rows
    without a vector are passed over; an empty catalogue gives no rows.
    A catalogue of up to ``block`` classes travels with the tasks and every
    item is scored where it lies; a larger one goes through ``nearest``.
    """
    classes = classes.select("candidate", "vector").filter("vector IS NOT NULL")
    head = classes.limit(block + 1).toPandas()
    if len(head) > block:
        found = nearest(items, classes.select(F.col("candidate").alias("node"), "vector"), 1)
        return found.select("query", F.col("node").alias("candidate"), "score")
    if head.empty:
        return items.join(classes.select("candidate"), F.lit(False)).select("query", "candidate", F.lit(0.0).alias("score"))
    head = head.sort_values("candidate", kind="stable")
    shared = items.sparkSession.sparkContext.broadcast((head["candidate"].to_numpy(), _unit(head["vector"])))
    schema = T.StructType([T.StructField("query", items.schema["query"].dataType),
                           T.StructField("candidate", classes.schema["candidate"].dataType),
                           T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit = shared.value
        for batch in batches:
            scores = np.round(_unit(batch["vector"]) @ unit.T, 6)
            best = scores.argmax(axis=1)
            yield pd.DataFrame({"query": batch["query"].to_numpy(), "candidate": names[best],
                                "score": scores[np.arange(len(best)), best]})

    return items.select("query", "vector").filter("vector IS NOT NULL").mapInPandas(score, schema)


def canonical_iri(tenant: str | Column, ontology_class: Column, label: Column, scheme: str = vocab.SCHEME,
                  length: int = 64) -> Column:
    """``{scheme}://{tenant}/entity/{local class}/{hash of the label}``.

    ``length`` shortens the digest; eight digits collide beyond some ten
    thousand labels and would merge them.
    """
    tenant = F.lit(tenant) if isinstance(tenant, str) else tenant
    name = F.substring_index(F.substring_index(ontology_class, "/", -1), "#", -1)
    return F.concat(F.lit(f"{scheme}://"), tenant, F.lit("/entity/"), name, F.lit("/"),
                    F.substring(F.sha2(label, 256), 1, length))


def resolve_entities(candidates: DataFrame, nodes: DataFrame, tenant: str, scheme: str = vocab.SCHEME,
                     threshold: float = RESOLUTION_THRESHOLD, length: int = 64, index=None) -> DataFrame:
    """Canonical IRI of each candidate: exact node, near node, or a new one.

    With a stored ``index`` of the nodes (``vector_index.build`` with their IRIs and
    classes) candidates visit only the cells of their class that can hold their nearest node.

    ``candidates``: ``label``, ``ontology_class``, nullable ``embedding``;
    ``nodes``: ``iri``, ``class`` (local name), ``embedding``. A candidate given
    with several embeddings is resolved with each, and its best hit counts.
    """
    named = candidates.select("label", "ontology_class", "embedding").withColumn(
        "query", F.sha2(F.concat_ws("\u001f", "ontology_class", "label"), 256))
    c = named.select("label", "ontology_class", "query").distinct()
    known = nodes.select(F.col("iri").alias("label")).distinct()
    is_iri = F.col("label").startswith("http") | F.col("label").startswith(f"{scheme}://")
    flagged = c.join(known.withColumn("_known", F.lit(True)), "label", "left")
    exact = (flagged.filter(is_iri & F.col("_known").isNotNull())
             .select("label", "ontology_class", F.col("label").alias("canonical_iri"), F.lit(False).alias("is_new"),
                     F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("same_as_iri")))
    rest = flagged.filter(~(is_iri & F.col("_known").isNotNull())).drop("_known")
    vectors = named.join(rest.select("query"), "query", "left_semi").filter("embedding IS NOT NULL").select(
        F.concat("query", F.lit(":"), F.xxhash64("embedding").cast("string")).alias("query"), F.col("embedding").alias("vector"),
        local_name(F.col("ontology_class")).alias("class")).dropDuplicates(["query"])
    if index is None:
        near = nearest(vectors, nodes.select(F.col("iri").alias("node"), F.col("embedding").alias("vector"), "class"), 5, by_class=True)
    else:
        from quadrille.operators.vector_index import search as search_index

        near = search_index(vectors, index, 1, by_class=True, exact=True)
    near = near.filter((F.col("rank") == 1) & (F.col("score") >= threshold))
    # Of equal scores the smaller IRI.
    hit = near.groupBy(F.substring_index("query", ":", 1).alias("query")).agg(F.min(F.struct((-F.col("score")).alias("s"), "node")).alias("b")).select(
        "query", "b.node", (-F.col("b.s")).alias("score"))
    own = canonical_iri(tenant, F.col("ontology_class"), F.col("label"), scheme, length)
    found = F.col("node").isNotNull()
    others = rest.join(hit, "query", "left").select(
        "label", "ontology_class", F.when(found, F.col("node")).otherwise(own).alias("canonical_iri"),
        (~found).alias("is_new"), F.when(found, F.round("score", 4)).otherwise(F.lit(1.0)).alias("confidence"),
        F.when(found, own).alias("same_as_iri"))
    return exact.unionByName(others)


def same_as_triples(resolved: DataFrame, graph: str) -> DataFrame:
    """``owl:sameAs`` from the merged IRI to the canonical one."""
    rows = resolved.filter("same_as_iri IS NOT NULL AND same_as_iri <> canonical_iri")
    return explode_quads(rows, [quad(F.col("same_as_iri"), vocab.SAME_AS, F.col("canonical_iri"), "iri", graph=graph)])


@F.pandas_udf(T.DoubleType())
def string_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings, ignoring case."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio()
                      for x, y in zip(a, b)], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    """Built-in alternative: one minus edit distance over the longer length, ignoring case."""
    a, b = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def merge_confidence(iris: DataFrame, group: str, iri: str, prefix: str, exact: bool = False) -> DataFrame:
    """Canonical IRI per group and the mean ratio of the others against it, rounded to 4.

    The ratio is ``edit_ratio``; ``exact`` asks for that of matching blocks, which runs in Python.
    """
    from quadrille.operators.quality import canonical, settled

    best = canonical(iris.select(group, iri), group, iri, prefix)
    pairs = iris.select(group, iri).distinct().join(best, group).filter(F.col(iri) != F.col("canonical"))
    ratio = string_ratio(F.col("canonical"), F.col(iri)) if exact else edit_ratio(F.col("canonical"), F.col(iri))
    scored = pairs.withColumn("_r", ratio).groupBy(group).agg(F.avg("_r").alias("_mean"), F.count("*").alias("merged"))
    return best.join(scored, group, "left").select(
        group, "canonical", F.coalesce("merged", F.lit(0)).alias("merged"),
        settled(F.coalesce("_mean", F.lit(1.0)), 4).alias("confidence"))


def words(col: Column) -> Column:
    """Tokens of two or more word characters, lower case."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all whitespace tokens; zero when both are empty."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def tfidf_similarity(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """TF-IDF cosine of each query with each candidate that shares a token.

    ``queries``: ``query``, ``text``; ``candidates``: ``candidate``, ``text``.
    The corpus of a query is the candidates plus itself, with smoothed idf and
    unit length vectors. A query changes the document frequency of its own
    tokens only, so the candidate norms are kept once and corrected by the
    shared tokens. Queries are dealt out by the pairs they make.
    """
    from quadrille.operators import text_index  # which takes its words from here

    return text_index.all_scores(queries, text_index.index_texts(candidates))


def match_type(score: Column) -> Column:
    result = F.lit(None).cast("string")
    for bound, name in reversed(MATCH_TYPES):
        result = F.when(score >= bound, name).otherwise(result)
    return result


def align_classes(drafts: DataFrame, scores: DataFrame) -> DataFrame:
    """Best candidate per draft class with its match type; below the last bound none.

    ``drafts``: ``query``; ``scores``: ``query``, ``candidate``, ``score``.
    """
    # Scores are compared at 9 places, so that ties go to the smallest candidate; they are made and read once.
    rounded = F.round("score", 9)
    best = scores.filter(F.col("score").isNotNull()).groupBy("query").agg(
        F.min_by("candidate", F.struct(~F.isnan(rounded), -rounded, "candidate")).alias("_candidate"), F.max("score").alias("_score"))
    confidence = F.coalesce("_score", F.lit(0.0))
    kind = match_type(confidence)
    return drafts.select("query").join(best, "query", "left").select(
        "query", F.when(kind.isNotNull(), F.col("_candidate")).alias("matched"), confidence.alias("confidence"),
        kind.alias("match_type"))


def align_schema(fields: DataFrame, labels: DataFrame) -> DataFrame:
    """Field names to properties: exact label 0.95, without underscores 0.80, else 0.

    ``fields``: ``field``; ``labels``: ``label``, ``property`` in catalogue
    order ``position``.
    """
    normal = F.trim(F.regexp_replace(F.lower("field"), "-", "_"))
    compact = lambda c: F.regexp_replace(c, "_", "")
    by_label = labels.groupBy(F.col("label").alias("_label")).agg(F.max_by("property", "position").alias("_exact"))
    by_compact = labels.groupBy(compact(F.col("label")).alias("_compact")).agg(F.min_by("property", "position").alias("_close"))
    f = fields.withColumn("_label", normal).withColumn("_compact", compact(normal))
    exact, close = F.col("_exact").isNotNull(), F.col("_close").isNotNull()
    return f.join(by_label, "_label", "left").join(by_compact, "_compact", "left").select(
        *fields.columns, F.coalesce("_exact", "_close").alias("property"),
        F.when(exact, 0.95).when(close, 0.80).otherwise(0.0).alias("confidence"),
        F.when(exact, "exact").when(close, "embedding").otherwise("unmatched").alias("match_type"))


def search(entities: DataFrame, text: str, types: Sequence[str] | None = None, context: str | None = None,
           limit: int = 20) -> DataFrame:
    """Entities whose label contains the text or shares words with it, best first."""
    if types:
        entities = entities.filter(F.col("type").isin(list(types)))
    if context is not None:
        entities = entities.filter(F.col("context") == context)
    inside = F.lower("label").contains(text.lower())
    score = F.when(F.lower("label") == text.lower(), F.lit(1.0)).otherwise(
        F.greatest(jaccard(F.col("label"), F.lit(text)), F.when(inside, F.lit(0.5)).otherwise(F.lit(0.0))))
    return (entities.withColumn("score", score).filter("score > 0")
            .orderBy(F.desc("score"), "iri").limit(limit))


def resolution_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("is_new").agg(F.count("*").alias("entities"))
