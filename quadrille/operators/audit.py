"""Provenance, lineage, audit listings and change tracking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille import vocab
from quadrille.functions.columns import iso_time, quoted
from quadrille.operators import patterns as P
from quadrille.operators.quality import page
from quadrille.operators.traverse import reach
from quadrille.operators.triples import QuadSource, explode_quads, of_predicates, quad
from quadrille.session import materialise
from quadrille.vocab import PROV, TYPE, XSD

CONTEXT = {"prov": PROV, "xsd": XSD, "kg": vocab.ONTOLOGY}

AUDIT_ACTIONS = ("query", "ingest", "export", "login", "logout", "schema_change", "policy_change")

LINEAGE_EVENT = ("eventType string, eventTime string, job struct<namespace:string,name:string>, "
                 "run struct<runId:string,facets:struct<`{facet}`:struct<tenant_id:string,source_type:string,record_count:bigint,"
                 "triples_added:bigint,triples_quarantined:bigint,shacl_violations:bigint>>>")


def _typed(col: Column) -> Column:
    return F.struct(iso_time(col).alias("@value"), F.lit("xsd:dateTime").alias("@type"))


def _ref(col: Column) -> Column:
    return F.when(col.isNotNull(), F.struct(col.alias("@id")))


def _document(iri: Column, kind: str, *fields: Column) -> Column:
    context = F.struct(*[F.lit(v).alias(k) for k, v in CONTEXT.items()])
    # to_json leaves out null fields, which is how optional parts stay absent.
    return F.to_json(F.struct(context.alias("@context"), iri.alias("@id"), F.lit(kind).alias("@type"), *fields))


def query_activity_iri(base: str = vocab.RESOURCE) -> Column:
    return F.concat(F.lit(base + "prov/query/"), "query_hash")


def query_documents(runs: DataFrame) -> DataFrame:
    """JSON-LD provenance per query run: (query_hash, document).

    ``runs``: ``query_hash``, ``context``, ``query_text``, ``user_iri``,
    ``used_graphs`` array, ``result_iri``, ``started_at``, ``ended_at``.
    """
    c = F.col
    used = F.when(F.size("used_graphs") > 0, F.transform("used_graphs", lambda g: F.struct(g.alias("@id"))))
    return runs.select("query_hash", _document(
        query_activity_iri(), "prov:Activity", _typed(c("started_at")).alias("prov:startedAtTime"),
        _typed(c("ended_at")).alias("prov:endedAtTime"), c("query_hash").alias("kg:queryHash"), c("context").alias("kg:context"),
        c("query_text").alias("kg:queryText"), _ref(c("user_iri")).alias("prov:wasAssociatedWith"), used.alias("prov:used"),
        _ref(c("result_iri")).alias("prov:generated")).alias("document"))


def query_triples(runs: DataFrame, graph: Column | str, base: str = vocab.ONTOLOGY, predicates: Sequence[str] | None = None) -> DataFrame:
    """The same provenance as quads, with the tenant where the runs carry one; with ``predicates`` only those are made."""
    a, c, dt = F.col("_a"), F.col, XSD + "dateTime"
    rows = runs.withColumn("_a", query_activity_iri())
    if "tenant_id" not in rows.columns:
        rows = rows.withColumn("tenant_id", F.lit(None).cast("string"))
    rows = rows.withColumn("_g", graph if isinstance(graph, Column) else F.lit(graph))
    made = [(TYPE, F.lit(PROV + "Activity"), "iri", None), (PROV + "startedAtTime", iso_time(c("started_at")), "literal", dt),
            (PROV + "endedAtTime", iso_time(c("ended_at")), "literal", dt), (base + "queryHash", c("query_hash"), "literal", None),
            (base + "context", c("context"), "literal", None), (base + "tenantId", c("tenant_id"), "literal", None),
            (PROV + "wasAssociatedWith", c("user_iri"), "iri", None), (PROV + "generated", c("result_iri"), "iri", None)]
    wanted = lambda p: predicates is None or p in predicates
    used = [F.transform("used_graphs", lambda u: quad(a, PROV + "used", u, "iri", graph=c("_g")))] if wanted(PROV + "used") else []
    return explode_quads(rows, [quad(a, p, o, kind, datatype, graph=c("_g")) for p, o, kind, datatype in made if wanted(p)], more=used)


def ingestion_documents(runs: DataFrame, base: str = vocab.RESOURCE) -> DataFrame:
    """JSON-LD provenance per ingestion: (job_id, document)."""
    c = F.col
    return runs.select("job_id", _document(
        F.concat(F.lit(base + "prov/ingest/"), "job_id"), "prov:Activity", _typed(c("started_at")).alias("prov:startedAtTime"),
        _typed(c("ended_at")).alias("prov:endedAtTime"), _ref(c("source_iri")).alias("prov:used"),
        _ref(c("tenant_iri")).alias("prov:wasAssociatedWith"), c("triples_added").alias("kg:triplesAdded"),
        c("ontology_version").alias("kg:ontologyVersion"), c("extraction_model").alias("kg:extractionModel"),
        _ref(c("named_graph_iri")).alias("prov:generated")).alias("document"))


def ingestion_triples(runs: DataFrame, graph: str, base: str = vocab.ONTOLOGY, resource: str = vocab.RESOURCE) -> DataFrame:
    a, c = F.concat(F.lit(resource + "prov/ingest/"), "job_id"), F.col
    return explode_quads(runs, [
        quad(a, TYPE, F.lit(PROV + "Activity"), "iri", graph=graph),
        quad(a, PROV + "startedAtTime", iso_time(c("started_at")), "literal", XSD + "dateTime", graph=graph),
        quad(a, PROV + "endedAtTime", iso_time(c("ended_at")), "literal", XSD + "dateTime", graph=graph),
        quad(a, PROV + "used", c("source_iri"), "iri", graph=graph),
        quad(a, PROV + "wasAssociatedWith", c("tenant_iri"), "iri", graph=graph),
        quad(a, base + "triplesAdded", c("triples_added").cast("string"), "literal", XSD + "integer", graph=graph),
        quad(a, base + "ontologyVersion", c("ontology_version"), graph=graph),
        quad(a, base + "extractionModel", c("extraction_model"), graph=graph),
        quad(a, PROV + "generated", c("named_graph_iri"), "iri", graph=graph)])


def derivation_triples(derivations: DataFrame, graph: str, predicates: Sequence[str] | None = None) -> DataFrame:
    """(entity_iri, source_iri, nullable activity_iri) to ``prov:wasDerivedFrom`` and ``prov:wasGeneratedBy``; only ``predicates`` if given."""
    e = F.col("entity_iri")
    made = [(TYPE, F.lit(PROV + "Entity")), (PROV + "wasDerivedFrom", F.col("source_iri")), (PROV + "wasGeneratedBy", F.col("activity_iri"))]
    return explode_quads(derivations, [quad(e, p, o, "iri", graph=graph) for p, o in made if predicates is None or p in predicates]).distinct()


def derivation_documents(derivations: DataFrame) -> DataFrame:
    """JSON-LD documents, one for each entity and source: (entity_iri, source_iri, document).

    Documents of one entity have the same ``@id``, which JSON-LD reads as one
    node with all the sources; so no list grows with the data.
    """
    rows = derivations.groupBy("entity_iri", "source_iri").agg(F.min("activity_iri").alias("_a"))
    return rows.select("entity_iri", "source_iri", _document(
        F.col("entity_iri"), "prov:Entity", F.array(F.struct(F.col("source_iri").alias("@id"))).alias("prov:wasDerivedFrom"),
        _ref(F.col("_a")).alias("prov:wasGeneratedBy")).alias("document"))


def provenance_chain(quads: QuadSource, entities: DataFrame | None = None) -> DataFrame:
    """(entity, activity, agent, time, source) of generated entities; all but the activity optional."""
    base = P.match(quads, [("?entity", PROV + "wasGeneratedBy", "?activity")])
    if entities is not None:
        base = base.join(entities.select("entity").distinct(), "entity", "left_semi")
    for predicate, name in (("wasAssociatedWith", "agent"), ("endedAtTime", "time"), ("used", "source")):
        base = P.optional(base, quads, [("?activity", PROV + predicate, f"?{name}")])
    return base


def lineage_trace(quads: QuadSource, iri: str | None = None, limit: int | None = 100) -> DataFrame:
    """Activities that used an entity: (entity, activity, agent, start_time, end_time).

    With ``iri`` the newest ``limit`` steps of that entity; without it all
    steps of all entities.
    """
    entity = iri or "?entity"
    found = P.match(quads, [("?activity", PROV + "used", entity), ("?activity", PROV + "wasAssociatedWith", "?agent"),
                            ("?activity", PROV + "startedAtTime", "?start_time"), ("?activity", PROV + "endedAtTime", "?end_time")])
    if iri is None:
        return found
    found = found.withColumn("entity", F.lit(iri))
    return found if limit is None else found.orderBy(F.desc("start_time"), "activity").limit(limit)


def lineage_edges(quads: QuadSource) -> DataFrame:
    """From each thing to what it came from: derivation, generation, use."""
    directs = [PROV + "wasDerivedFrom", PROV + "wasGeneratedBy", PROV + "used"]
    forward = of_predicates(quads, directs).select(
        F.col("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object").alias("tgt"))
    back = of_predicates(quads, [PROV + "generated"]).select(
        F.col("object").alias("src"), F.col("predicate").alias("rel"), F.col("subject").alias("tgt"))
    return forward.unionByName(back)


def transitive_lineage(quads: QuadSource, entities: DataFrame) -> DataFrame:
    """(entity, origin, depth): everything an entity came from, directly or not."""
    seeds = entities.select(F.col("entity").alias("src"))
    return reach(lineage_edges(quads), seeds).select(F.col("src").alias("entity"), F.col("tgt").alias("origin"), "depth")


def provenance_by_hash(quads: QuadSource, hashes: DataFrame, base: str = vocab.ONTOLOGY) -> DataFrame:
    """Triples of the activities with these query hashes and of what they generated."""
    activities = (P.match(quads, [("?activity", base + "queryHash", "?query_hash")])
                  .join(hashes.select("query_hash").distinct(), "query_hash", "left_semi").select("activity").distinct())
    # Read again below.
    activities = materialise(activities, "activities")
    made = P.match(quads, [("?entity", PROV + "wasGeneratedBy", "?activity")]).join(activities, "activity", "left_semi")
    wanted = activities.select(F.col("activity").alias("subject")).union(made.select("entity"))
    # All quads are made and compared once.
    return of_predicates(quads, None).join(wanted, "subject", "left_semi").dropDuplicates(vocab.QUAD_COLUMNS)


def export_window(quads: DataFrame, tenant: str, start: str, end: str, base: str = vocab.ONTOLOGY) -> DataFrame:
    """Quads of the tenant's activities started in the inclusive window (ISO times)."""
    picked = P.match(quads, [("?activity", TYPE, PROV + "Activity"), ("?activity", base + "tenantId", P.Literal(tenant)),
                             ("?activity", PROV + "startedAtTime", "?t")])
    at = F.col("t").cast("timestamp_ntz")
    picked = picked.filter((at >= F.lit(start).cast("timestamp_ntz")) & (at <= F.lit(end).cast("timestamp_ntz"))).select(F.col("activity").alias("subject")).distinct()
    return quads.join(picked, "subject", "left_semi")


def list_audit(log: DataFrame, tenant_id: str | None = None, user_id: str | None = None, context: str | None = None,
               action: str | None = None, status: str | None = None, date_from: str | None = None, date_to: str | None = None,
               limit: int = 50, offset: int = 0) -> DataFrame:
    """Audit rows, newest first, by any of seven filters."""
    for name, value in (("tenant_id", tenant_id), ("user_id", user_id), ("context", context), ("action", action), ("status", status)):
        if value is not None:
            log = log.filter(F.col(name) == value)
    kind = log.schema["created_at"].dataType
    if date_from is not None:
        log = log.filter(F.col("created_at") >= F.lit(date_from).cast(kind))
    if date_to is not None:
        log = log.filter(F.col("created_at") <= F.lit(date_to).cast(kind))
    return page(log, "created_at", "id", limit, offset)


def audit_statistics(log: DataFrame, tenant_id: str | None = None, top: int = 10) -> DataFrame:
    """(measure, name, count): total, by action, by status, top users, top contexts.

    One pass counts every combination of the four columns; all five results
    are sums over that much smaller table.
    """
    if tenant_id is not None:
        log = log.filter(F.col("tenant_id") == tenant_id)
    cube = log.groupBy("action", "status", "user_id", "context").agg(F.count("*").alias("_n"))
    name = lambda measure, col: F.struct(F.lit(measure).alias("measure"), col.cast("string").alias("name"))
    rows = cube.select("_n", F.explode(F.array(
        name("total", F.lit(None)), name("action", F.col("action")), name("status", F.col("status")),
        name("user", F.col("user_id")), name("context", F.col("context")))).alias("_m")).select("_m.*", "_n")
    counts = (rows.filter("measure <> 'context' OR name IS NOT NULL").groupBy("measure", "name")
              .agg(F.sum("_n").alias("count")))
    w = Window.partitionBy("measure").orderBy(F.desc("count"), "name")
    ranked = counts.filter("measure IN ('user', 'context')").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top)
    return counts.filter("measure NOT IN ('user', 'context')").unionByName(ranked.drop("_r"))


def lineage_to_audit(events: DataFrame, value: str = "value", facet: str = "ingestion") -> DataFrame:
    """Lineage event JSON to audit rows; ``facet`` names the run facet with the tenant.

    Other event types are left out, and so are records that cannot be read:
    ``unreadable_events`` gives those.
    """
    e = F.from_json(F.col(value).cast("string"), LINEAGE_EVENT.replace("{facet}", facet), {"mode": "PERMISSIVE"})
    parsed = events.withColumn("_e", e).withColumn("_type", F.upper("_e.eventType"))
    status = F.when(F.col("_type") == "COMPLETE", "success").when(F.col("_type") == "FAIL", "error").otherwise("started")
    return parsed.filter(F.col("_type").isin("COMPLETE", "FAIL", "START")).select(
        F.coalesce(F.col(f"_e.run.facets.`{facet}`.tenant_id"), F.lit("unknown")).alias("tenant_id"), F.lit("ingest").alias("action"),
        status.alias("status"), F.col("_e.job.name").alias("context"), F.col("_e.run.runId").alias("query_hash"),
        F.col("_e.eventTime").try_cast("timestamp").alias("created_at"), F.col(value).cast("string").alias("prov_jsonld"),
        F.to_json(F.struct(F.col("_type").alias("event_type"), F.col("_e.job").alias("job"))).alias("metadata"))


def unreadable_events(events: DataFrame, value: str = "value") -> DataFrame:
    """Records that are no JSON object, or have no event type."""
    e = F.from_json(F.col(value).cast("string"), "eventType string", {"mode": "PERMISSIVE"})
    return events.filter(e["eventType"].isNull())


def column_profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """(column, type, rows, nulls, distinct) in one pass.

    Distinct counts are sketches unless ``exact``; exact counts expand every
    row once per column.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    aggregates = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        col = F.col("`" + c.replace("`", "``") + "`")
        aggregates += [F.count_if(col.isNull()).alias(f"n{i}"), distinct(col).alias(f"d{i}")]
    per_column = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.col(f"n{i}").alias("nulls"),
                                    F.col(f"d{i}").alias("distinct")) for i, (c, t) in enumerate(df.dtypes)])
    return df.agg(*aggregates).select(F.inline(per_column))


def drift(before: DataFrame, after: DataFrame, exact: bool = False) -> DataFrame:
    """Column changes between two loads: added, removed, retyped or same, with the change of null rate and distinct count."""
    a, b = column_profile(before, exact), column_profile(after, exact)
    rate = lambda side: F.try_divide(F.col(f"{side}.nulls"), F.col(f"{side}.rows"))
    change = (F.when(F.col("a.column").isNull(), "added").when(F.col("b.column").isNull(), "removed")
              .when(F.col("a.type") != F.col("b.type"), "retyped").otherwise("same"))
    return a.alias("a").join(b.alias("b"), F.col("a.column") == F.col("b.column"), "full_outer").select(
        F.coalesce("a.column", "b.column").alias("column"), change.alias("change"), F.col("a.type").alias("old_type"),
        F.col("b.type").alias("new_type"), (rate("b") - rate("a")).alias("null_rate_change"),
        (F.col("b.distinct") - F.col("a.distinct")).alias("distinct_change"))


def version_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that were added, removed or modified, by a full outer join of row hashes.

    Only keys and 64-bit hashes are shuffled. Values are hashed in one column
    order, with nulls told apart from empty values.
    """
    values = sorted((set(old.columns) | set(new.columns)) - set(key))

    def hashed(df: DataFrame, name: str) -> DataFrame:
        parts = [F.to_json(F.struct(F.col(c).alias("v"))) if c in df.columns else F.lit("absent") for c in values]
        return df.select(*key, F.xxhash64(*parts).alias(name))

    a, b = hashed(old, "_o"), hashed(new, "_n")
    # Null keys meet null keys.
    renamed = b.withColumnsRenamed({k: f"_{i}" for i, k in enumerate(key)})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(key)])
    joined = a.join(renamed, same, "full_outer").withColumns({k: F.when(F.col("_o").isNull(), F.col(f"_{i}")).otherwise(F.col(k)) for i, k in enumerate(key)})
    change = (F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
              .when(F.col("_o") != F.col("_n"), "modified"))
    return joined.select(*key, change.alias("change")).filter("change IS NOT NULL")


def key_profile(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """(table, column, rows, nulls, distinct, candidate): unique, non-null columns are key candidates."""
    return column_profile(df, exact).select(
        F.lit(table).alias("table"), "column", "rows", "nulls", "distinct",
        ((F.col("nulls") == 0) & (F.col("distinct") == F.col("rows"))).alias("candidate"))


def reference_profile(df: DataFrame, column: str, target: DataFrame, target_column: str, name: str) -> DataFrame:
    """(name, values, missing, included): how many distinct values have no match in the target."""
    values = df.select(F.col(column).alias("_v")).filter("_v IS NOT NULL").distinct()
    known = target.select(F.col(target_column).alias("_v")).distinct().withColumn("_k", F.lit(True))
    return values.join(known, "_v", "left").agg(F.count("*").alias("values"), F.count_if(F.col("_k").isNull()).alias("missing")).select(
        F.lit(name).alias("name"), "values", "missing", (F.col("missing") == 0).alias("included"))


def discovered_references(tables: Mapping[str, DataFrame], keys_only: bool = True) -> DataFrame:
    """(dependent, referenced, values): every pair of columns where the values of one are all among those of the other.

    All tables are explored at once by an inverted list: each value of a column (whole
    numbers and texts; long texts by their digest) is grouped with the columns that hold it, in one shuffle.
    Values with the same set of columns then count together, and a pair is an
    inclusion if it shares all values of the dependent column. Sets are as long as there are columns.
    With ``keys_only`` the referenced column has no value twice.
    """
    parts, names, numbers = [], [], []
    for table, df in tables.items():
        cells = []
        for f in df.schema.fields:
            kind = "number" if isinstance(f.dataType, T.IntegralType) else "text" if isinstance(f.dataType, T.StringType) else None
            if kind is None:
                continue
            value = quoted(f.name).cast("string")
            if kind == "text":
                value = F.when(F.length(value) > 64, F.sha2(value, 256)).otherwise(value)
            cells.append(F.struct(F.lit(len(names)).alias("column"), F.lit(kind).alias("kind"), value.alias("value")))
            names.append(f"{table}.{f.name}")
        if cells:
            # Each value once per column and task goes on.
            counted = df.select(F.inline(F.array(*cells))).filter("value IS NOT NULL").groupBy("column", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
            parts.append(counted)
    if not parts:
        raise ValueError("no column of whole numbers or text")
    spark = parts[0].sparkSession
    listed = spark.createDataFrame(list(enumerate(names)), "column int, name string")
    values = reduce(DataFrame.unionByName, parts)
    # One row per value, then one per set of columns that occurs.
    held = values.groupBy("kind", "value").agg(F.array_sort(F.collect_list("column")).alias("columns"),
                                               F.collect_list(F.when(F.col("n") > 1, F.col("column"))).alias("repeated"))
    sets = held.groupBy("columns", F.array_sort("repeated").alias("repeated")).agg(F.count(F.lit(1)).alias("n"))
    sets = materialise(sets, "value-sets")
    each = sets.select("n", "columns", F.explode("columns").alias("a"))
    total = each.groupBy("a").agg(F.sum("n").alias("values"))
    shared = each.select("n", "a", F.explode("columns").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    found = shared.join(total, "a").filter(F.col("shared") == F.col("values"))
    if keys_only:
        found = found.join(sets.select(F.explode("repeated").alias("b")).distinct(), "b", "left_anti")
    of = lambda c: listed.select(F.col("column").alias(c), F.col("name").alias(f"_{c}"))
    return found.join(F.broadcast(of("a")), "a").join(F.broadcast(of("b")), "b").select(
        F.col("_a").alias("dependent"), F.col("_b").alias("referenced"), "values")


def service_indicators(requests: DataFrame, time: str = "ts", window: str = "5 minutes", slide: str | None = None,
                       max_error_rate: float = 0.05, min_hit_rate: float = 0.7) -> DataFrame:
    """Per window: requests, error rate, cache hit ratio, ingestion throughput, alert flags.

    ``requests``: a time column, ``is_error``, ``is_hit``, ``is_miss`` and ``ingested``. Works on
    batch and streaming input alike.
    """
    w = F.window(time, window, slide) if slide else F.window(time, window)
    e, h, m = (F.count_if(F.col(c)) for c in ("is_error", "is_hit", "is_miss"))
    agg = requests.groupBy(w.alias("window")).agg(
        F.count("*").alias("requests"), e.alias("errors"), h.alias("hits"), m.alias("misses"), F.sum("ingested").alias("ingested"))
    seconds = F.unix_timestamp(F.col("window.end").cast("timestamp")) - F.unix_timestamp(F.col("window.start").cast("timestamp"))
    rate = F.col("errors") / F.col("requests")
    hit = F.try_divide(F.col("hits"), F.col("hits") + F.col("misses"))
    return agg.select(
        F.col("window.start").alias("window_start"), "requests", rate.alias("error_rate"), hit.alias("hit_rate"),
        (F.col("ingested") / seconds).alias("ingested_per_second"), (rate > max_error_rate).alias("high_error_rate"),
        F.coalesce(hit < min_hit_rate, F.lit(False)).alias("low_hit_rate"))
