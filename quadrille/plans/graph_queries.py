"""Knowledge-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille import vocab
from quadrille.operators import patterns as P
from quadrille.operators import traverse as V
from quadrille.operators import triples as T
from quadrille.plans.kg import BANK, ONT, RES, graph, graph_of, quads, sql_quads
from quadrille.plans.registry import query
from quadrille.session import ROWS_TO_QUADS, deal, scratch_path
from quadrille.vocab import TYPE


@query("g1_merge_quads", f"""
    SELECT graph, COUNT(*) AS triples FROM (SELECT DISTINCT * FROM (
        {sql_quads('customer')} UNION ALL {sql_quads('customer', 'supplier')})) GROUP BY 1""")
def _(t):
    return T.graph_counts(T.merge_quads(quads(t, "customer", dealt=True), quads(t, "customer", "supplier", dealt=True)))


@query("g1_append_quads", f"""
    SELECT graph, COUNT(*) AS inserted FROM ({sql_quads('orders')}) GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "quads")
    T.append_quads(quads(t, "customer", "supplier", dealt=True), path)
    # Customers are stored already; only the orders are new.
    return T.append_quads(quads(t, "customer", "orders", dealt=True), path)


@query("g2_rows_to_triples", sql_quads())
def _(t):
    return quads(t)


@query("g3_reference_triples", f"""
    SELECT * FROM ({sql_quads('orders')}) WHERE predicate IN ('{ONT}fromAccount', '{TYPE}')""")
def _(t):
    return quads(t, "orders", predicates=[ONT + "fromAccount", TYPE])


@query("g4_property_table", f"""
    SELECT '{RES}customer/' || c_custkey AS subject, c_name AS name, c_mktsegment AS segment,
           CAST(c_acctbal AS VARCHAR) AS balance, '{RES}nation/' || c_nationkey AS nation
    FROM customer""")
def _(t):
    return T.property_table(graph(t), ONT + "Account", {
        "name": ONT + "name", "segment": ONT + "segment", "balance": ONT + "balance", "nation": ONT + "inNation"})


EXPOSURE_PATTERN = [
    ("?tx", TYPE, ONT + "FinancialTransaction"), ("?tx", ONT + "fromAccount", "?account"),
    ("?tx", ONT + "amount", "?amount"), ("?tx", ONT + "currency", P.Literal("EUR")),
    ("?account", TYPE, ONT + "Account"), ("?account", ONT + "name", "?name"),
    ("?account", ONT + "inNation", "?nation"), ("?nation", ONT + "name", "?jurisdiction"),
]


@query("g5_exposure_by_pattern", """
    SELECT c_name AS name, n_name AS jurisdiction, COUNT(*) AS transactions,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS exposure
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus = 'F' GROUP BY 1, 2 ORDER BY 4 DESC, 1 LIMIT 20""")
def _(t):
    found = P.match(graph(t), EXPOSURE_PATTERN)
    return (found.groupBy("name", "jurisdiction")
            .agg(F.count("*").alias("transactions"), F.sum(F.col("amount").cast("decimal(18,4)")).alias("exposure"))
            .withColumn("exposure", F.col("exposure").cast("double"))
            .orderBy(F.desc("exposure"), "name").limit(20))


@query("j6_pattern_self_joins", f"""
    SELECT '{RES}order/' || o_orderkey AS tx, '{RES}customer/' || c_custkey AS account, '{RES}nation/' || n_nationkey AS nation,
           n_name AS country
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    return P.match(graph(t), [("?tx", ONT + "fromAccount", "?account"), ("?account", ONT + "inNation", "?nation"),
                              ("?nation", ONT + "name", "?country")])


@query("g5_shared_object_terms", f"""
    SELECT subject AS a, predicate AS p, object AS x FROM ({sql_quads()}) WHERE predicate = '{ONT}name'""")
def _(t):
    # The object is shared, so value, kind, datatype and language must agree.
    return P.match(graph(t), [("?a", ONT + "name", "?x"), ("?a", "?p", "?x")])


@query("g6_graph_variable", f"""
    SELECT graph AS g, COUNT(*) AS named, COUNT(DISTINCT object) AS names
    FROM ({sql_quads()}) WHERE predicate IN ('{ONT}name') GROUP BY 1""")
def _(t):
    found = P.match(graph(t), [("?s", ONT + "name", "?n"), ("?s", TYPE, "?c")], graph="?g")
    return found.groupBy("g").agg(F.count("*").alias("named"), F.count_distinct("n").alias("names"))


@query("g6_one_graph", f"""
    SELECT '{RES}customer/' || c_custkey AS s, c_name AS n FROM customer""")
def _(t):
    return P.match(graph(t), [("?s", ONT + "name", "?n")], graph=graph_of("customer"))


@query("g6_graph_type", f"SELECT COUNT(*) AS triples FROM ({sql_quads()})")
def _(t):
    return P.scope(quads(t), kind="instance").agg(F.count("*").alias("triples"))


@query("g7_optional_union_filter_bind", f"""
    WITH a AS (SELECT '{RES}order/' || o_orderkey AS tx, CAST(o_totalprice AS DECIMAL(18,4)) AS amount, 'high' AS tier
               FROM orders WHERE o_totalprice > 400000
               UNION ALL SELECT '{RES}order/' || o_orderkey, CAST(o_totalprice AS DECIMAL(18,4)), 'suspicious'
               FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT tx, CAST(amount AS DOUBLE) AS amount, tier, o_totalprice > 300000 AS big,
           CASE WHEN o_orderstatus <> 'P' AND c_acctbal > 0 THEN c_name END AS name
    FROM a JOIN orders ON tx = '{RES}order/' || o_orderkey LEFT JOIN customer ON o_custkey = c_custkey""")
def _(t):
    q = graph(t)
    amount = F.col("amount").cast("decimal(18,4)")
    base = [("?tx", ONT + "amount", "?amount")]
    high = P.match(q, base).filter(amount > 400000).withColumn("tier", F.lit("high"))
    flagged = P.match(q, [*base, ("?tx", ONT + "isSuspicious", P.Literal("true", vocab.XSD + "boolean"))])
    both = P.union([high, flagged.withColumn("tier", F.lit("suspicious"))])
    # Names only of solvent accounts of settled transactions.
    solvent = P.match(q, [("?tx", ONT + "currency", "?currency"), ("?tx", ONT + "fromAccount", "?account"),
                          ("?account", ONT + "balance", "?balance"), ("?account", ONT + "name", "?name")])
    solvent = solvent.filter("currency <> 'GBP' AND cast(balance AS decimal(18,4)) > 0").select("tx", "name")
    return both.join(solvent, "tx", "left").select(
        "tx", amount.cast("double").alias("amount"), "tier", (amount > 300000).alias("big"), "name")


@query("g8_construct", f"""
    SELECT DISTINCT '{RES}customer/' || o_custkey AS subject, '{ONT}paidFrom' AS predicate,
           '{RES}nation/' || c_nationkey AS object, 'iri' AS object_kind, CAST(NULL AS VARCHAR) AS datatype,
           CAST(NULL AS VARCHAR) AS lang, '{graph_of('derived')}' AS graph
    FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL
    SELECT '{RES}order/' || o_orderkey, '{ONT}payer', c_name, 'literal', '{vocab.XSD}string', NULL, '{graph_of('derived')}'
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    found = P.match(graph(t), [("?tx", ONT + "fromAccount", "?a"), ("?a", ONT + "inNation", "?n"), ("?a", ONT + "name", "?name")])
    return T.construct(found, [("?a", ONT + "paidFrom", "?n"), ("?tx", ONT + "payer", "?name", "literal", vocab.XSD + "string")],
                       graph_of("derived"))


@query("g9_ask", """
    SELECT g AS graph, EXISTS (SELECT 1 FROM nation WHERE g = 'nation') AS "exists" FROM (VALUES ('nation'), ('absent')) v(g)""")
def _(t):
    q = quads(t)
    parts = [P.scope(q, graph_of(g)).limit(1).agg((F.count("*") > 0).alias("exists")).select(F.lit(g).alias("graph"), "exists")
             for g in ("nation", "absent")]
    return parts[0].unionByName(parts[1])


@query("g10_list_graphs", f"SELECT DISTINCT graph FROM ({sql_quads()})")
def _(t):
    return T.list_graphs(quads(t))


@query("g10_graph_counts", f"SELECT graph, COUNT(*) AS triples FROM ({sql_quads()}) GROUP BY 1")
def _(t):
    return T.graph_counts(quads(t))


@query("g10_drop_graph", f"""
    SELECT graph, COUNT(*) AS triples FROM ({sql_quads()}) WHERE graph <> '{graph_of('orders')}' GROUP BY 1""")
def _(t):
    return T.graph_counts(T.drop_graph(quads(t), graph_of("orders")))


@query("g10_drop_stored_graph", f"""
    SELECT graph, predicate, COUNT(*) AS triples FROM ({sql_quads('customer', 'supplier')}) WHERE graph <> '{graph_of('customer')}' GROUP BY 1, 2""")
def _(t):
    path = scratch_path(t.spark, "quads")
    T.write_quads(quads(t, "customer", "supplier", dealt=True), path)
    # Some predicates belong to the dropped graph only, others to both.
    T.drop_stored_graph(t.spark, path, graph_of("customer"))
    return T.read_quads(t.spark, path).groupBy("graph", "predicate").agg(F.count("*").alias("triples"))


@query("g11_sequence_path", f"""
    SELECT '{RES}region/' || n_regionkey AS region, COUNT(*) AS transactions
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    walked = P.path(graph(t), "?tx", [ONT + "fromAccount", ONT + "inNation", ONT + "inRegion"], "?region")
    return walked.groupBy("region").agg(F.count("*").alias("transactions"))


UPWARD = [ONT + "fromAccount", ONT + "inNation", ONT + "inRegion"]


@query("g12_unbounded_path", f"""
    WITH RECURSIVE e AS (SELECT subject AS src, object AS tgt FROM ({sql_quads()})
                         WHERE predicate IN ('{UPWARD[0]}', '{UPWARD[1]}', '{UPWARD[2]}')),
    r AS (SELECT src, tgt, 1 AS depth FROM e UNION SELECT r.src, e.tgt, depth + 1 FROM r JOIN e ON r.tgt = e.src)
    SELECT src, tgt, MIN(depth) AS depth FROM r GROUP BY 1, 2""")
def _(t):
    return V.reach(V.edges_of(graph(t), UPWARD))


# Turns of a conversation follow each other: paths as long as a conversation.
def _replies(t):
    a = t.conversations.select("conv_id", F.col("turn").alias("x"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("x"))
    node = lambda turn: F.format_string("c/%d/%05d", "conv_id", turn)
    return (a.join(b, ["conv_id", "x"]).select(node(F.col("x")).alias("src"), F.lit("next").alias("rel"),
                                               node(F.col("x") + 1).alias("tgt")))


REPLIES_SQL = """e AS (SELECT DISTINCT printf('c/%d/%05d', a.conv_id, a.turn) AS src, printf('c/%d/%05d', b.conv_id, b.turn) AS tgt
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


@query("g12_reply_chain_closure", f"""
    WITH RECURSIVE {REPLIES_SQL},
    r AS (SELECT src, tgt, 1 AS depth FROM e UNION SELECT r.src, e.tgt, depth + 1 FROM r JOIN e ON r.tgt = e.src)
    SELECT src, tgt, MIN(depth) AS depth FROM r GROUP BY 1, 2
    UNION ALL SELECT n, n, 0 FROM (SELECT src AS n FROM e UNION SELECT tgt FROM e)""")
def _(t):
    return V.reach(_replies(t), reflexive=True)


@query("g13_bounded_traversal", f"""
    SELECT '{RES}region/' || r_regionkey AS seed, '{RES}region/' || r_regionkey AS src, '{ONT}inRegion' AS rel,
           '{RES}nation/' || n_nationkey AS tgt, 1 AS depth FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT '{RES}region/' || n_regionkey, '{RES}nation/' || n_nationkey, '{ONT}inNation',
           '{RES}customer/' || c_custkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey
    UNION ALL SELECT '{RES}region/' || n_regionkey, '{RES}nation/' || n_nationkey, '{ONT}inNation',
           '{RES}supplier/' || s_suppkey, 2 FROM nation JOIN supplier ON s_nationkey = n_nationkey
    UNION ALL SELECT '{RES}region/' || n_regionkey, '{RES}customer/' || c_custkey, '{ONT}fromAccount',
           '{RES}order/' || o_orderkey, 3
           FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey""")
def _(t):
    down = V.edges_of(graph(t), UPWARD).select(F.col("tgt").alias("src"), "rel", F.col("src").alias("tgt"))
    seeds = t.region.select(F.concat(F.lit(RES + "region/"), "r_regionkey").alias("seed"))
    return V.traverse(down, seeds, 3, UPWARD)


@query("g14_entity_subgraph", f"""
    SELECT '{RES}nation/' || n_nationkey AS seed, '{RES}nation/' || n_nationkey AS node, 0 AS depth FROM nation
    UNION ALL SELECT '{RES}nation/' || c_nationkey, '{RES}customer/' || c_custkey, 1 FROM customer
    UNION ALL SELECT '{RES}nation/' || s_nationkey, '{RES}supplier/' || s_suppkey, 1 FROM supplier
    UNION ALL SELECT '{RES}nation/' || c_nationkey, '{RES}order/' || o_orderkey, 2 FROM customer JOIN orders ON o_custkey = c_custkey""")
def _(t):
    down = V.edges_of(graph(t), UPWARD).select(F.col("tgt").alias("src"), "rel", F.col("src").alias("tgt"))
    seeds = t.nation.select(F.concat(F.lit(RES + "nation/"), "n_nationkey").alias("seed"))
    return V.subgraph_nodes(V.traverse(down, seeds, 2))


@query("g15_entity_detail", f"SELECT subject, predicate, object, object_kind, datatype, lang, graph FROM ({sql_quads('supplier')})")
def _(t):
    banks = P.match(graph(t), [("?subject", TYPE, BANK)])
    return V.entity_detail(quads(t), banks)


@query("g15_entity_types", f"""
    SELECT subject, list_sort(list(DISTINCT object)) AS types FROM ({sql_quads()}) WHERE predicate = '{TYPE}' GROUP BY 1""")
def _(t):
    return V.entity_types(quads(t))


@query("g16_upsert_nodes", """
    SELECT user_id AS iri, arg_max(event_type, event_id) AS last_type,
           arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase
    FROM events GROUP BY 1""")
def _(t):
    versions = t.events.select(F.col("user_id").alias("iri"), F.col("event_id").alias("seq"),
                               F.col("event_type").alias("last_type"),
                               F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"))
    return T.upsert_nodes(versions)


@query("g16_upsert_property_maps", """
    SELECT user_id AS iri, event_type AS k, arg_max(CAST(event_id AS VARCHAR), event_id) AS v FROM events GROUP BY 1, 2""")
def _(t):
    versions = t.events.select(F.col("user_id").alias("iri"), F.col("event_id").alias("seq"),
                               F.create_map("event_type", F.col("event_id").cast("string")).alias("properties"))
    return T.upsert_property_maps(versions).select("iri", F.explode("properties").alias("k", "v"))


@query("g17_merge_edges", """
    SELECT user_id AS from_iri, event_type AS edge_type, CAST(props ->> '$.k' AS BIGINT) AS to_iri,
           arg_max(value, event_id) AS weight, MAX(event_id) AS seq
    FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)
      AND CAST(props ->> '$.k' AS BIGINT) IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2, 3""")
def _(t):
    edges = t.events.select(F.col("user_id").alias("from_iri"), F.col("event_type").alias("edge_type"),
                            F.get_json_object("props", "$.k").cast("bigint").alias("to_iri"),
                            F.col("value").alias("weight"), F.col("event_id").alias("seq"))
    return T.merge_edges(edges, t.supplier.select(F.col("s_suppkey").alias("iri")))


def _schema(t):
    """Segment classes below Account below Agent; names are labels; nations are places."""
    seg = t.customer.select(F.concat(F.lit(ONT + "segment/"), "c_mktsegment").alias("s")).distinct()
    fixed = [("Account", vocab.SUBCLASS, "Agent"), ("name", vocab.SUBPROPERTY, "label"),
             ("label", vocab.SUBPROPERTY, "annotation"), ("inNation", vocab.DOMAIN, "Located"),
             ("inNation", vocab.RANGE, "Place"), ("Place", vocab.SUBCLASS, "Thing")]
    rows = T.explode_quads(t.spark.range(1), [
        T.quad(F.lit(ONT + s), p, F.lit(ONT + o), "iri", graph="schema") for s, p, o in fixed])
    return rows.unionByName(T.explode_quads(seg, [
        T.quad(F.col("s"), vocab.SUBCLASS, F.lit(ONT + "Account"), "iri", graph="schema")]))


@query("g18_rdfs_closure", f"""
    WITH people AS (SELECT COUNT(*) AS n FROM customer), banks AS (SELECT COUNT(*) AS n FROM supplier),
    used AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer)),
    used2 AS (SELECT COUNT(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier)),
    seg AS (SELECT COUNT(DISTINCT c_mktsegment) AS n FROM customer)
    SELECT '{TYPE}' AS predicate, '{ONT}segment/' || c_mktsegment AS class, COUNT(*) AS n FROM customer GROUP BY 2
    UNION ALL SELECT '{TYPE}', '{ONT}' || c, people.n FROM people, (VALUES ('Account'), ('Agent')) v(c)
    UNION ALL SELECT '{TYPE}', '{BANK}', n FROM banks
    UNION ALL SELECT '{TYPE}', '{ONT}Located', people.n + banks.n FROM people, banks
    UNION ALL SELECT '{TYPE}', '{ONT}' || c, used.n + used2.n FROM used, used2, (VALUES ('Place'), ('Thing')) v(c)
    UNION ALL SELECT '{ONT}' || p, NULL, people.n FROM people, (VALUES ('name'), ('label'), ('annotation'), ('segment')) v(p)
    UNION ALL SELECT '{ONT}' || p, NULL, people.n + banks.n FROM people, banks, (VALUES ('balance'), ('inNation')) v(p)
    UNION ALL SELECT '{ONT}legalName', NULL, n FROM banks
    UNION ALL SELECT '{vocab.SUBCLASS}', NULL, 2 + 2 * n FROM seg
    UNION ALL SELECT '{vocab.SUBPROPERTY}', NULL, 3
    UNION ALL SELECT '{vocab.DOMAIN}', NULL, 1 UNION ALL SELECT '{vocab.RANGE}', NULL, 1""")
def _(t):
    typed = T.explode_quads(deal(t.customer, "c_custkey", rows=ROWS_TO_QUADS), [T.quad(
        F.concat(F.lit(RES + "customer/"), "c_custkey"), TYPE, F.concat(F.lit(ONT + "segment/"), "c_mktsegment"), "iri",
        graph=graph_of("customer"))])
    closed = V.rdfs_closure(quads(t, "customer", "supplier", dealt=True).unionByName(typed).unionByName(_schema(t)))
    return (closed.groupBy("predicate", F.when(F.col("predicate") == TYPE, F.col("object")).alias("class"))
            .agg(F.count("*").alias("n")))


@query("g19_import_closure", """
    WITH RECURSIVE i AS (SELECT doc_id AS src, doc_id // 2 AS tgt FROM documents WHERE doc_id > 0),
    r AS (SELECT doc_id AS root, doc_id AS document, 0 AS depth FROM labels WHERE toxic = 1
          UNION SELECT r.root, i.tgt, r.depth + 1 FROM r JOIN i ON r.document = i.src)
    SELECT root, document, MIN(depth) AS depth FROM r GROUP BY 1, 2""")
def _(t):
    imports = t.documents.filter("doc_id > 0").select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("tgt"))
    roots = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("src"))
    return V.import_closure(imports, roots)


@query("g20_align_predicates", f"""
    SELECT CASE predicate WHEN '{ONT}name' THEN 'https://target/label' WHEN '{ONT}balance' THEN 'https://target/amount'
                ELSE predicate END AS predicate,
           predicate = '{ONT}segment' AS quarantined, COUNT(*) AS n FROM ({sql_quads()}) GROUP BY 1, 2""")
def _(t):
    mapping = t.spark.createDataFrame(
        [("name", "https://target/label", True), ("balance", "https://target/amount", True),
         (ONT + "segment", None, False)], "source_field string, target_property string, accepted boolean")
    return T.align_predicates(quads(t), mapping).groupBy("predicate", "quarantined").agg(F.count("*").alias("n"))


@query("g21_exact_matches", f"""
    SELECT '{ONT}' || name AS subject, '{vocab.EXACT_MATCH}' AS predicate,
           COALESCE(explicit, CASE lower(name) WHEN 'brand#1' THEN 'urn:brand:1' WHEN 'brand#2' THEN 'urn:brand:2' END) AS object,
           'iri' AS object_kind, CAST(NULL AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS graph
    FROM (SELECT DISTINCT p_brand AS name, CASE WHEN p_brand = 'Brand#3' THEN 'urn:explicit:3' END AS explicit FROM part)
    WHERE explicit IS NOT NULL OR lower(name) IN ('brand#1', 'brand#2')""")
def _(t):
    entities = t.part.select(F.col("p_brand").alias("name"),
                             F.when(F.col("p_brand") == "Brand#3", "urn:explicit:3").alias("explicit_class")).distinct()
    known = t.spark.createDataFrame([("Brand#1", "urn:brand:1"), ("BRAND#2", "urn:brand:2")], "name string, iri string")
    return T.exact_matches(entities, known)


@query("g22_module_counts", """
    SELECT p_type AS graph, COUNT(*) AS classes, COUNT(*) AS properties, CAST(COUNT_IF(p_size > 25) AS BIGINT) AS shapes
    FROM part GROUP BY 1""")
def _(t):
    iri = F.concat(F.lit(RES + "part/"), "p_partkey")
    rows = T.explode_quads(t.part, [
        T.quad(iri, TYPE, F.lit(vocab.OWL + "Class"), "iri", graph=F.col("p_type")),
        T.quad(F.concat(iri, F.lit("/p")), TYPE, F.lit(vocab.OWL + "DatatypeProperty"), "iri", graph=F.col("p_type")),
        T.quad(F.concat(iri, F.lit("/s")), TYPE, F.when(F.col("p_size") > 25, vocab.SH + "NodeShape"), "iri",
               graph=F.col("p_type"))])
    return T.module_counts(rows)


@query("e7_same_as_clusters", f"""
    WITH {REPLIES_SQL.replace('DISTINCT ', '')}, n AS (SELECT src AS node FROM e UNION SELECT tgt FROM e)
    SELECT node, MIN(node) OVER (PARTITION BY split_part(node, '/', 2)) AS component FROM n""")
def _(t):
    return V.components(_replies(t))
