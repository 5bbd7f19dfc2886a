"""Fixpoints and bounded walks over edge tables (``src``, ``rel``, ``tgt``).

Every round is one shuffle join; its result is written to the shared folder, so
lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille import vocab
from quadrille.session import deal, materialise
from quadrille.operators.triples import QuadSource, of_predicates, quad
from quadrille.vocab import QUAD_COLUMNS, TYPE


def edges_of(quads: QuadSource, predicates: Sequence[str] | None = None) -> DataFrame:
    """Node-to-node quads as edges."""
    edges = of_predicates(quads, predicates).filter(F.col("object_kind") != "literal")
    return edges.select(F.col("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object").alias("tgt"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def reach(edges: DataFrame, seeds: DataFrame | None = None, reflexive: bool = False) -> DataFrame:
    """``p+`` (or ``p*``): all (src, tgt) with a path, and its shortest length.

    Without ``seeds`` every source starts and paths double: a shortest path of
    n + 1 to 2 n links is one of n links and a shorter one, so the pairs at a distance of n meet all
    pairs found so far, and a path of any length takes the logarithm of it in rounds.

    ``seeds`` has a column ``src``. Then each round extends only the pairs found in the
    last one; when this has not ended after ``PATIENCE`` rounds, stretches of nodes with one link in
    and one out are replaced by one long link (found by doubling) and filled in at the end.
    """
    links = edges.select(F.col("src").alias("_mid"), F.col("tgt").alias("_next")).distinct()
    result = _doubled(links) if seeds is None else _extended(links, seeds.select("src").distinct())
    if reflexive:
        own = (seeds.select("src") if seeds is not None
               else edges.select("src").union(edges.select(F.col("tgt").alias("src")))).distinct()
        zero = own.select("src", F.col("src").alias("tgt"), F.lit(0).alias("depth"))
        result = result.filter("src <> tgt").unionByName(zero)
    return result


def _doubled(links: DataFrame) -> DataFrame:
    """All pairs with a path, by doubling."""
    found = [materialise(links.select(F.col("_mid").alias("src"), F.col("_next").alias("tgt"), F.lit(1).alias("depth")), "reach")]
    length = 1
    while True:
        # A pair at a distance of ``length`` and a pair of any distance so far.
        head = found[-1].filter(F.col("depth") == length).select("src", F.col("tgt").alias("_mid"))
        tail = _union(found).select(F.col("src").alias("_mid"), "tgt", F.col("depth").alias("_rest"))
        step = (head.join(tail, "_mid").groupBy("src", "tgt").agg((F.min("_rest") + length).cast("int").alias("depth"))
                .join(_union(found).select("src", "tgt"), ["src", "tgt"], "left_anti"))
        step = materialise(step, "reach")
        if step.isEmpty():
            return _union(found)
        found.append(step)
        length *= 2


# Rounds of single links before long stretches are looked for.
PATIENCE = 8


def _extended(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs reached from the seeds, link by link, or stretch by stretch where that takes long."""
    frontier = materialise(seeds.join(links, F.col("src") == F.col("_mid"))
                           .select("src", F.col("_next").alias("tgt"), F.lit(1).alias("depth")), "reach")
    found = [frontier]
    for depth in range(2, PATIENCE + 2):
        if frontier.isEmpty():
            return _union(found)
        step = (frontier.join(links, frontier["tgt"] == links["_mid"])
                .select("src", F.col("_next").alias("tgt")).distinct()
                .join(_union(found).select("src", "tgt"), ["src", "tgt"], "left_anti")
                .withColumn("depth", F.lit(depth)))
        frontier = materialise(step, "reach")
        found.append(frontier)
    return _union(found) if frontier.isEmpty() else _by_stretches(materialise(links, "links"), seeds)


def _stretches(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Inner nodes of stretches with the node before and after their stretch and the links to each: (node, head, up, end, down).

    An inner node has one link in and one link out and is no seed. Pointers double until
    they leave the stretch; rings of inner nodes cannot be reached and are left out.
    """
    into = links.groupBy(F.col("_next").alias("node")).agg(F.count("*").alias("n"), F.min("_mid").alias("head"))
    out = links.groupBy(F.col("_mid").alias("node")).agg(F.count("*").alias("n"), F.min("_next").alias("end"))
    single = into.filter("n = 1").drop("n").join(out.filter("n = 1").drop("n"), "node").filter("node <> head")
    inner = single.join(seeds.select(F.col("src").alias("node")), "node", "left_anti")
    state = materialise(inner.select("node", "head", F.lit(1).alias("up"), "end", F.lit(1).alias("down")), "stretch")
    size = state.count()
    done, span = [], 1
    while True:
        names = state.select("node")
        back = state.select(F.col("node").alias("head"), F.col("head").alias("_h"), F.col("up").alias("_u"))
        on = state.select(F.col("node").alias("end"), F.col("end").alias("_e"), F.col("down").alias("_d"))
        step = (state.join(back, "head", "left").join(on, "end", "left").select(
            "node", F.coalesce("_h", "head").alias("head"), (F.col("up") + F.coalesce("_u", F.lit(0))).alias("up"),
            F.coalesce("_e", "end").alias("end"), (F.col("down") + F.coalesce("_d", F.lit(0))).alias("down"),
            (F.col("_h").isNull() & F.col("_e").isNull()).alias("_done")))
        step = materialise(step, "stretch")
        if span > size or step.filter("NOT _done").isEmpty():
            ended = step.drop("_done")
            return (ended.join(names.select(F.col("node").alias("head")), "head", "left_anti")
                    .join(names.select(F.col("node").alias("end")), "end", "left_anti").select("node", "head", "up", "end", "down"))
        state, span = step.drop("_done"), span * 2


def _by_stretches(links: DataFrame, seeds: DataFrame) -> DataFrame:
    inner = materialise(_stretches(links, seeds), "inner")
    names = inner.select(F.col("node").alias("_next"))
    direct = (links.join(names, "_next", "left_anti").join(inner.select(F.col("node").alias("_mid")), "_mid", "left_anti")
              .select("_mid", "_next", F.lit(1).alias("length")))
    long = inner.filter("up = 1").select(F.col("head").alias("_mid"), F.col("end").alias("_next"), (F.col("down") + 1).alias("length"))
    outer = materialise(direct.unionByName(long).groupBy("_mid", "_next").agg(F.min("length").alias("length")), "outer")
    # Shortest lengths over links of several lengths: what got shorter is extended again.
    known = materialise(seeds.select("src", F.col("src").alias("tgt"), F.lit(0).alias("depth"), F.lit(True).alias("new")), "known")
    while True:
        more = (known.filter("new").join(outer, known["tgt"] == outer["_mid"])
                .groupBy("src", F.col("_next").alias("tgt")).agg(F.min(F.col("depth") + F.col("length")).cast("int").alias("_d")))
        # The way back to a seed is not its empty path, so it has a row of its own name.
        old = known.select("src", "tgt", "depth")
        known = materialise(old.join(more, ["src", "tgt"], "full").select(
            "src", "tgt", F.least("depth", "_d").alias("depth"), (F.coalesce(F.col("_d") < F.col("depth"), F.col("depth").isNull())).alias("new")), "known")
        if known.filter("new").isEmpty():
            break
    reached = known.select("src", "tgt", "depth")
    inside = inner.join(reached.select("src", F.col("tgt").alias("head"), "depth"), "head").select(
        "src", F.col("node").alias("tgt"), (F.col("depth") + F.col("up")).cast("int").alias("depth"))
    # Back at a seed after at least one link.
    back = (reached.join(outer, reached["tgt"] == outer["_mid"]).filter("_next = src")
            .groupBy("src").agg(F.min(F.col("depth") + F.col("length")).cast("int").alias("depth"))
            .select("src", F.col("src").alias("tgt"), "depth"))
    return reached.filter("depth > 0").unionByName(inside).unionByName(back)


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 2, rel_types: Sequence[str] | None = None) -> DataFrame:
    """Edges within ``depth`` hops of each seed: (seed, src, rel, tgt, depth).

    Every edge appears once per seed, at its smallest hop count. ``seeds`` has
    a column ``seed``.
    """
    if depth < 1:
        raise ValueError("depth starts at 1")
    if rel_types:
        edges = edges.filter(F.col("rel").isin(list(rel_types)))
    edges = edges.select("src", "rel", "tgt").distinct()
    frontier = seeds.select("seed", F.col("seed").alias("src")).distinct()
    seen, hops = [frontier], []
    for hop in range(1, depth + 1):
        step = frontier.join(edges, "src").select("seed", "src", "rel", "tgt", F.lit(hop).alias("depth"))
        if hop < depth:
            step = materialise(step, "hop")
            frontier = materialise(
                step.select("seed", F.col("tgt").alias("src")).distinct()
                .join(_union(seen), ["seed", "src"], "left_anti"), "frontier")
        hops.append(step)
        if hop < depth:
            if frontier.isEmpty():
                break
            seen.append(frontier)
    return _union(hops)


def subgraph_nodes(walk: DataFrame) -> DataFrame:
    """Nodes of each seed's subgraph with their smallest distance."""
    ends = (walk.select("seed", F.col("src").alias("node"), (F.col("depth") - 1).alias("depth"))
            .unionByName(walk.select("seed", F.col("tgt").alias("node"), "depth")))
    return ends.groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def entity_detail(quads: DataFrame, iris: DataFrame) -> DataFrame:
    """(graph, predicate, object) of the listed subjects; ``iris`` has ``subject``."""
    return quads.join(iris.select("subject").distinct(), "subject", "left_semi")


def entity_types(quads: DataFrame) -> DataFrame:
    """Distinct types per subject as a sorted array."""
    return (quads.filter(F.col("predicate") == TYPE).groupBy("subject")
            .agg(F.array_sort(F.collect_set("object")).alias("types")))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), component = smallest node.

    Alternates the large-star and small-star contractions of Kiveris et al.
    (SoCC 2014), which need O(log² n) rounds whatever the diameter. A hub's
    neighbours are never collected: its minimum is an aggregate with map-side
    combine, joined back to the edges.
    """
    ends = edges.select(F.col("src").alias("u"), F.col("tgt").alias("v")).filter("u <> v")
    nodes = materialise(edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct(), "nodes")
    # Larger node first.
    state = materialise(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
        # Larger neighbours move to the smallest one known.
        large = (both.filter("v > u").join(least, "u").filter("v <> _m")
                 .select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct())
        large = materialise(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        # Smaller neighbours and the node itself move to the smallest one.
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("_m").alias("v"))
                 .union(small.select("u", F.col("_m").alias("v"))).filter("u <> v").distinct())
        state = materialise(small, "cc")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    labels = state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_c"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("_c", "node").alias("component"))


def rdfs_closure(quads: DataFrame) -> DataFrame:
    """RDFS entailment for data whose schema is not itself derived.

    The schema is closed first: per predicate its super-properties and the
    classes its domain and range imply, per class its super-classes. These
    tables are as large as the schema. The data then meets them in one pass and
    every quad emits what follows from it.
    """
    terms = [vocab.SUBPROPERTY, vocab.SUBCLASS, vocab.DOMAIN, vocab.RANGE]
    # Small selections of a large table: read it once.
    links = materialise(edges_of(quads, terms), "schema")
    direct = lambda p: links.filter(F.col("rel") == p).select("src", "tgt")
    super_property = reach(direct(vocab.SUBPROPERTY)).select("src", "tgt")
    super_class = reach(direct(vocab.SUBCLASS)).select("src", "tgt")

    def implied(term: str) -> DataFrame:
        """Predicate to every class its domain or range makes a node a member of."""
        own = direct(term)
        inherited = super_property.withColumnRenamed("tgt", "_up").join(
            own.select(F.col("src").alias("_up"), "tgt"), "_up").select("src", "tgt")
        classes = own.union(inherited)
        above = classes.withColumnRenamed("tgt", "_c").join(
            super_class.select(F.col("src").alias("_c"), "tgt"), "_c").select("src", "tgt")
        return classes.union(above)

    tagged = _union([df.withColumn("_k", F.lit(k)) for k, df in (
        ("up", super_property), ("domain", implied(vocab.DOMAIN)), ("range", implied(vocab.RANGE)))])
    listed = lambda k: F.collect_set(F.when(F.col("_k") == k, F.col("tgt"))).alias(f"_{k}")
    by_predicate = tagged.groupBy(F.col("src").alias("predicate")).agg(listed("up"), listed("domain"), listed("range"))
    by_class = super_class.groupBy(F.col("src").alias("_class")).agg(F.collect_set("tgt").alias("_classes"))

    # Stored, their size is known: what is small is broadcast, and the data is not sorted by a few predicates.
    by_predicate, by_class = materialise(by_predicate, "by-predicate"), materialise(by_class, "by-class")
    none = F.array().cast("array<string>")
    rows = quads.select(*QUAD_COLUMNS).join(by_predicate, "predicate", "left")
    is_type = (F.col("predicate") == TYPE) | F.array_contains(F.coalesce("_up", none), TYPE)
    # Rows that state no class get keys that no class has, so that they do not meet in one task.
    none_of = F.concat(F.lit("\0"), F.pmod(F.xxhash64("subject", "object"), F.lit(1 << 20)).cast("string"))
    rows = rows.withColumn("_class", F.when(is_type, F.col("object")).otherwise(none_of)).join(by_class, "_class", "left")
    each = lambda name, make: F.transform(F.coalesce(name, none), make)
    g = F.col("graph")
    s, o = F.col("subject"), F.col("object")
    emitted = F.concat(
        F.array(quad(s, F.col("predicate"), o, F.col("object_kind"), F.col("datatype"), F.col("lang"), g)),
        each("_up", lambda p: quad(s, p, o, F.col("object_kind"), F.col("datatype"), F.col("lang"), g)),
        each("_classes", lambda c: quad(s, TYPE, c, "iri", graph=g)),
        each("_domain", lambda c: quad(s, TYPE, c, "iri", graph=g)),
        F.when(F.col("object_kind") != "literal", each("_range", lambda c: quad(o, TYPE, c, "iri", graph=g))).otherwise(
            F.array().cast("array<struct<subject:string,predicate:string,object:string,object_kind:string,datatype:string,"
                           "lang:string,graph:string>>")))
    entailed = rows.select(F.inline(emitted))
    # A schema link keeps the graph it was stated in; only new links have none.
    new_links = _union([
        pairs.withColumn("rel", F.lit(p)) for pairs, p in ((super_class, vocab.SUBCLASS), (super_property, vocab.SUBPROPERTY))
    ]).join(links.select("src", "tgt", "rel"), ["src", "tgt", "rel"], "left_anti")
    hierarchy = new_links.select(quad(F.col("src"), F.col("rel"), F.col("tgt"), "iri").alias("_q")).select("_q.*")
    return deal(entailed.unionByName(hierarchy), *QUAD_COLUMNS).dropDuplicates(QUAD_COLUMNS)


def import_closure(imports: DataFrame, roots: DataFrame) -> DataFrame:
    """Documents reached over import edges, each once, with its distance from a root."""
    found = reach(imports, roots, reflexive=True)
    return found.select(F.col("src").alias("root"), F.col("tgt").alias("document"), "depth")
