"""Similarity, resolution and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille import vocab
from quadrille.operators import quality as K
from quadrille.operators import similarity as S
from quadrille.operators import text_index as I
from quadrille.operators import vector_index as X
from quadrille.plans.registry import query
from quadrille.session import scratch_path

# The mean vector of each class, rounded so that both engines hold equal numbers.
CENTRES_SQL = """centres AS (SELECT label, list(m ORDER BY i) AS v FROM (
    SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS m
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1)"""


def _centres(t):
    """Component-wise averages: 64 aggregates with map-side combine, no arrays shuffled."""
    means = [F.round(F.avg(F.col("embedding")[i].cast("double")), 6) for i in range(64)]
    return t.embeddings.groupBy("label").agg(F.array(*means).alias("v"))


def _nodes(t):
    return t.embeddings.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"),
                               F.col("label").cast("string").alias("class"))


@query("e1_cosine", f"""
    WITH {CENTRES_SQL}
    SELECT vec_id, ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score
    FROM embeddings e JOIN centres c ON e.label = c.label""")
def _(t):
    return t.embeddings.join(_centres(t), "label").select(
        "vec_id", F.round(S.cosine(F.col("embedding"), F.col("v")), 6).alias("score"))


NEAREST_SQL = """
    WITH {centres}, s AS (SELECT c.label AS query, vec_id AS node,
        ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM centres c JOIN embeddings e ON {on})
    SELECT query, node, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM s) WHERE rank <= 10"""


@query("e2_vector_top_k", NEAREST_SQL.format(centres=CENTRES_SQL, on="TRUE"))
def _(t):
    queries = _centres(t).select(F.col("label").alias("query"), F.col("v").alias("vector"))
    return S.nearest(queries, _nodes(t), 10)


@query("e2_vector_top_k_in_class", NEAREST_SQL.format(centres=CENTRES_SQL, on="c.label = e.label"))
def _(t):
    queries = _centres(t).select(F.col("label").alias("query"), F.col("v").alias("vector"), F.col("label").cast("string").alias("class"))
    return S.nearest(queries, _nodes(t), 10, by_class=True)


@query("j9_nearest_neighbour_join", NEAREST_SQL.format(centres=CENTRES_SQL, on="TRUE"))
def _(t):
    # The same join through the grid of blocks that serves large query sets.
    queries = _centres(t).select(F.col("label").alias("query"), F.col("v").alias("vector"))
    return S.nearest(queries, _nodes(t), 10, query_block=4)


# Every 50th vector searches all vectors.
PROBED_SQL = """
    WITH s AS (SELECT q.vec_id AS query, e.vec_id AS node,
        ROUND(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
        FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0{same})
    SELECT query, node, score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM s) WHERE rank <= 10"""


def _index(t):
    return X.build(_nodes(t), scratch_path(t.spark, "index"))


def _probing(t):
    return _nodes(t).filter("node % 50 = 0").withColumnRenamed("node", "query")


@query("e2_vector_top_k_indexed", PROBED_SQL.format(same=""))
def _(t):
    return X.search(_probing(t), _index(t), 10, exact=True)


@query("j9_nearest_in_class_indexed", PROBED_SQL.format(same=" AND e.label = q.label"))
def _(t):
    return X.search(_probing(t), _index(t), 10, by_class=True, exact=True)


@query("e2_vector_index_recall", "SELECT COUNT(*) AS queries, TRUE AS enough FROM embeddings WHERE vec_id % 50 = 0")
def _(t):
    found = X.search(_probing(t), _index(t), 10)
    return X.recall(found, S.nearest(_probing(t), _nodes(t), 10)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


IRI = "http://kg.example/vector/"
RESOLVE_SQL = f"""
    WITH {CENTRES_SQL},
    probes AS (SELECT 'centre ' || label AS name, label, v FROM centres
               UNION ALL SELECT 'copy ' || label, label, list_transform(arg_min(embedding, vec_id), lambda x: round(CAST(x AS DOUBLE), 2))
               FROM embeddings GROUP BY label),
    near AS (SELECT name, label, arg_max(vec_id, (ROUND(s, 6), -vec_id)) AS vec_id, MAX(ROUND(s, 6)) AS score FROM (
        SELECT name, c.label, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(CAST(v AS FLOAT[]) AS DOUBLE[])) AS s
        FROM probes c JOIN embeddings e ON e.label = c.label) c GROUP BY 1, 2),
    all_rows AS (
        SELECT '{IRI}' || vec_id AS label, 'http://o/c' || label AS ontology_class, '{IRI}' || vec_id AS canonical_iri,
               FALSE AS is_new, 1.0::DOUBLE AS confidence, NULL AS same_as_iri FROM embeddings
        UNION ALL SELECT name, 'http://o/c' || label,
               CASE WHEN score >= 0.85 THEN '{IRI}' || vec_id ELSE 'kg://acme/entity/c' || label || '/' || sha256(name) END,
               score < 0.85, CASE WHEN score >= 0.85 THEN ROUND(score, 4) ELSE 1.0 END,
               CASE WHEN score >= 0.85 THEN 'kg://acme/entity/c' || label || '/' || sha256(name) END FROM near
        UNION ALL SELECT 'doc ' || doc_id, 'http://o#doc', 'kg://acme/entity/doc/' || sha256('doc ' || doc_id), TRUE, 1.0, NULL
        FROM labels)
    """


def _candidates(t):
    """Known vectors by IRI, centres and coarse copies by neighbourhood, labelled documents as new."""
    cls = F.concat(F.lit("http://o/c"), "label")
    own = t.embeddings.select(F.concat(F.lit(IRI), "vec_id").alias("label"), cls.alias("ontology_class"), "embedding")
    centres = _centres(t).select(F.concat(F.lit("centre "), "label").alias("label"), cls.alias("ontology_class"),
                                 F.col("v").cast("array<float>").alias("embedding"))
    copies = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).select(
        F.concat(F.lit("copy "), "label").alias("label"), cls.alias("ontology_class"),
        F.transform("v", lambda x: F.round(x.cast("double"), 2)).cast("array<float>").alias("embedding"))
    documents = t.labels.select(F.concat(F.lit("doc "), "doc_id").alias("label"), F.lit("http://o#doc").alias("ontology_class"),
                                F.lit(None).cast("array<float>").alias("embedding"))
    return own.unionByName(centres).unionByName(copies).unionByName(documents)


def _known(t):
    return t.embeddings.select(F.concat(F.lit(IRI), "vec_id").alias("iri"), F.concat(F.lit("c"), "label").alias("class"), "embedding")


def _resolved(t):
    return S.resolve_entities(_candidates(t), _known(t), "acme")


@query("e3_resolution_cascade", RESOLVE_SQL + "SELECT * FROM all_rows")
def _(t):
    return _resolved(t)


@query("e3_resolution_indexed", RESOLVE_SQL + "SELECT * FROM all_rows")
def _(t):
    known = _known(t)
    index = X.build(known.select(F.col("iri").alias("node"), F.col("embedding").alias("vector"), "class"), scratch_path(t.spark, "index"))
    return S.resolve_entities(_candidates(t), known, "acme", index=index)


@query("e4_canonical_iri", """
    SELECT c_custkey, 'kg://acme/entity/' || c_mktsegment || '/' || sha256(c_name) AS iri,
           'kg://acme/entity/' || c_mktsegment || '/' || left(sha256(c_name), 16) AS longer FROM customer""")
def _(t):
    cls = F.concat(F.lit("https://o/x#"), "c_mktsegment")
    return t.customer.select("c_custkey", S.canonical_iri("acme", cls, F.col("c_name")).alias("iri"),
                             S.canonical_iri("acme", cls, F.col("c_name"), length=16).alias("longer"))


@query("e5_same_as_triples", RESOLVE_SQL + f"""
    SELECT same_as_iri AS subject, '{vocab.SAME_AS}' AS predicate, canonical_iri AS object, 'iri' AS object_kind,
           CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS lang, 'resolution' AS graph
    FROM all_rows WHERE same_as_iri IS NOT NULL""")
def _(t):
    return S.same_as_triples(_resolved(t), "resolution")


@query("e6_edit_ratio", """
    SELECT p_brand, p_name, ROUND(CASE WHEN greatest(length(p_brand), length(p_name)) = 0 THEN 1.0
        ELSE 1 - levenshtein(lower(p_brand), lower(p_name)) / greatest(length(p_brand), length(p_name)) END, 6) AS ratio
    FROM (SELECT DISTINCT p_brand, p_name FROM part)""")
def _(t):
    pairs = t.part.select("p_brand", "p_name").distinct()
    return pairs.withColumn("ratio", F.round(S.edit_ratio(F.col("p_brand"), F.col("p_name")), 6))


@query("e6_merge_confidence")
def _(t):
    return S.merge_confidence(t.part.select("p_brand", "p_name"), "p_brand", "p_name", "red", exact=True)


@query("e6_merge_confidence_by_edits", """
    WITH d AS (SELECT DISTINCT p_brand, p_name FROM part),
    c AS (SELECT p_brand, p_name AS canonical FROM d QUALIFY row_number() OVER (
        PARTITION BY p_brand ORDER BY NOT starts_with(p_name, 'red'), length(p_name), p_name) = 1)
    SELECT p_brand, canonical, COUNT(r) AS merged,
        CAST(ROUND(CAST(ROUND(coalesce(AVG(r), 1.0), 9) AS DECIMAL(38,9)), 4) AS DOUBLE) AS confidence FROM (
        SELECT c.p_brand, canonical, CASE WHEN p_name <> canonical THEN 1 - levenshtein(lower(canonical), lower(p_name)) / greatest(length(canonical), length(p_name)) END AS r
        FROM c JOIN d ON d.p_brand = c.p_brand) GROUP BY 1, 2""")
def _(t):
    return S.merge_confidence(t.part.select("p_brand", "p_name"), "p_brand", "p_name", "red")


TFIDF_SQL = r"""
    WITH q AS (SELECT query, token, COUNT(*)::DOUBLE AS tf FROM (SELECT conv_id * 1000 + turn AS query,
                   unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM conversations) GROUP BY 1, 2),
    c AS (SELECT candidate, token, COUNT(*)::DOUBLE AS tf FROM (SELECT item_id AS candidate,
                   unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS token FROM benchmark) GROUP BY 1, 2),
    d AS (SELECT token, COUNT(*)::DOUBLE AS df FROM c GROUP BY 1),
    n AS (SELECT COUNT(*) + 2.0 AS n FROM benchmark),
    pairs AS (SELECT q.query, c.candidate FROM q JOIN c ON q.token = c.token GROUP BY 1, 2),
    qn AS (SELECT query, SUM(POW(tf * (LN(n / (COALESCE(df, 0) + 2)) + 1), 2)) AS qn
           FROM q LEFT JOIN d ON q.token = d.token, n GROUP BY 1),
    full_c AS (SELECT p.query, p.candidate, c.tf, q.tf AS tq,
                      LN(n / (df + 1 + CASE WHEN q.token IS NULL THEN 0 ELSE 1 END)) + 1 AS i
               FROM pairs p JOIN c ON p.candidate = c.candidate JOIN d ON c.token = d.token
               LEFT JOIN q ON q.query = p.query AND q.token = c.token, n),
    scores AS (SELECT f.query, candidate, SUM(COALESCE(tq, 0) * tf * i * i) / (SQRT(ANY_VALUE(qn)) * SQRT(SUM(tf * tf * i * i))) AS score
        FROM full_c f JOIN qn ON f.query = qn.query GROUP BY 1, 2)"""


@query("e8_tfidf_similarity", TFIDF_SQL + " SELECT query, candidate, ROUND(score, 6) AS score FROM scores")
def _(t):
    return _turn_scores(t).withColumn("score", F.round("score", 6))


def _turns(t):
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query"), "text")


def _turn_scores(t):
    return S.tfidf_similarity(_turns(t), _items(t))


def _items(t):
    return t.benchmark.select(F.col("item_id").alias("candidate"), "text")


@query("e8_top_k", TFIDF_SQL + """
    SELECT query, candidate, ROUND(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY ROUND(score, 9) DESC, candidate) AS rank FROM scores) WHERE rank <= 3""")
def _(t):
    return I.top_k(_turns(t), _items(t), 3).withColumn("score", F.round("score", 6))


@query("e9_jaccard", r"""
    SELECT conv_id, turn, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS score FROM (
        SELECT x.conv_id, x.turn, list_distinct(list_filter(regexp_split_to_array(lower(x.text), '\s+'), lambda s: s <> '')) AS a,
               list_distinct(list_filter(regexp_split_to_array(lower(y.text), '\s+'), lambda s: s <> '')) AS b
        FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)""")
def _(t):
    nxt = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return t.conversations.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", S.jaccard(F.col("text"), F.col("reply")).alias("score"))


@query("e10_class_alignment", TFIDF_SQL + """,
    best AS (SELECT query, candidate, score FROM scores QUALIFY row_number() OVER (PARTITION BY query ORDER BY ROUND(score, 9) DESC, candidate) = 1)
    SELECT conv_id * 1000 + turn AS query, CASE WHEN score >= 0.45 THEN candidate END AS matched, ROUND(coalesce(score, 0.0), 6) AS confidence,
           CASE WHEN score >= 0.92 THEN 'exactMatch' WHEN score >= 0.8 THEN 'closeMatch' WHEN score >= 0.65 THEN 'broadMatch'
                WHEN score >= 0.45 THEN 'relatedMatch' END AS match_type
    FROM conversations LEFT JOIN best ON query = conv_id * 1000 + turn""")
def _(t):
    aligned = S.align_classes(_turns(t), I.top_k(_turns(t), _items(t), 1))
    return aligned.withColumn("confidence", F.round("confidence", 6))


@query("e10_vector_alignment", f"""
    WITH {CENTRES_SQL}, s AS (SELECT vec_id AS query, c.label AS candidate,
        ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings e, centres c),
    b AS (SELECT query, arg_max(candidate, (score, -candidate)) AS candidate, MAX(score) AS score FROM s GROUP BY 1)
    SELECT query, CASE WHEN score >= 0.45 THEN candidate END AS matched, score AS confidence,
           CASE WHEN score >= 0.92 THEN 'exactMatch' WHEN score >= 0.8 THEN 'closeMatch' WHEN score >= 0.65 THEN 'broadMatch'
                WHEN score >= 0.45 THEN 'relatedMatch' END AS match_type FROM b""")
def _(t):
    items = t.embeddings.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    classes = _centres(t).select(F.col("label").alias("candidate"), F.col("v").alias("vector"))
    return S.align_classes(items, S.nearest_class(items, classes))


@query("e11_schema_alignment", """
    SELECT field, CASE WHEN field IN ('c-name', 'C_NAME') THEN 'kg:label' WHEN field = 'cname' THEN 'kg:label'
                       WHEN field = 'balance' THEN 'kg:amount' END AS property,
           CASE WHEN field IN ('c-name', 'C_NAME', 'balance') THEN 0.95::DOUBLE WHEN field = 'cname' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
           CASE WHEN field IN ('c-name', 'C_NAME', 'balance') THEN 'exact' WHEN field = 'cname' THEN 'embedding' ELSE 'unmatched' END AS match_type,
           event_id
    FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'c-name' WHEN 'view' THEN 'C_NAME' WHEN 'error' THEN 'cname'
                 WHEN 'signup' THEN 'balance' ELSE 'other' END AS field FROM events)""")
def _(t):
    e = F.col("event_type")
    fields = t.events.select("event_id", F.when(e == "click", "c-name").when(e == "view", "C_NAME").when(e == "error", "cname")
                             .when(e == "signup", "balance").otherwise("other").alias("field"))
    labels = t.spark.createDataFrame([("c_name", "kg:label", 0), ("balance", "kg:amount", 1)],
                                     "label string, property string, position int")
    return S.align_schema(fields, labels)


@query("e12_mapping_acceptance", """
    SELECT event_id AS source_field, value / 500 AS confidence, value / 500 >= 0.75 AS accepted FROM events""")
def _(t):
    return K.accept_mappings(t.events.select(F.col("event_id").alias("source_field"), (F.col("value") / 500).alias("confidence")))


@query("e12_mapping_statistics", """
    SELECT value / 500 >= 0.75 AS accepted, COUNT(*) AS n,
        CAST(ROUND(CAST(ROUND(AVG(value / 500), 9) AS DECIMAL(38,9)), 4) AS DOUBLE) AS mean FROM events GROUP BY 1""")
def _(t):
    m = K.accept_mappings(t.events.select((F.col("value") / 500).alias("confidence")))
    return m.groupBy("accepted").agg(F.count("*").alias("n"), K.settled(F.avg("confidence"), 4).alias("mean"))


@query("e13_entity_search", r"""
    WITH e AS (SELECT p_partkey AS iri, p_name AS label, p_type AS type FROM part WHERE p_type IN ('ECONOMY', 'PROMO')),
    t AS (SELECT *, list_distinct(regexp_split_to_array(lower(label), '\s+')) AS a, ['red', 'widget'] AS b FROM e)
    SELECT iri, label, type, CASE WHEN lower(label) = 'red widget' THEN 1.0 ELSE greatest(
        len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), CASE WHEN contains(lower(label), 'red widget') THEN 0.5 ELSE 0.0 END) END AS score
    FROM t WHERE len(list_intersect(a, b)) > 0 OR contains(lower(label), 'red widget')
    ORDER BY score DESC, iri LIMIT 20""")
def _(t):
    entities = t.part.select(F.col("p_partkey").alias("iri"), F.col("p_name").alias("label"), F.col("p_type").alias("type"))
    return S.search(entities, "Red Widget", types=["ECONOMY", "PROMO"], limit=20)


@query("e14_resolution_counts", RESOLVE_SQL + "SELECT is_new, COUNT(*) AS entities FROM all_rows GROUP BY 1")
def _(t):
    return S.resolution_counts(_resolved(t))
