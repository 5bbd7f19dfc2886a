"""The supplied tables as a knowledge graph: row mappings and their SQL twin."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille import vocab
from quadrille.functions.columns import template
from quadrille.operators.triples import Field, Link, RowMapping, mapped, rows_to_triples
from quadrille.session import ROWS_TO_QUADS, deal

RES, ONT, XSD = vocab.RESOURCE, vocab.ONTOLOGY, vocab.XSD
BANK = ONT + "finance/Bank"
CURRENCY = {"F": "EUR", "O": "USD", "P": "GBP"}


def graph_of(table: str) -> str:
    return f"{vocab.SCHEME}://acme/instance/{table}/v1"


MAPPINGS = {
    "region": RowMapping(RES + "region/{r_regionkey}", (ONT + "Region",), (Field("r_name", ONT + "name"),)),
    "nation": RowMapping(RES + "nation/{n_nationkey}", (ONT + "Nation",), (Field("n_name", ONT + "name"),),
                         (Link(ONT + "inRegion", RES + "region/{n_regionkey}"),)),
    "customer": RowMapping(
        RES + "customer/{c_custkey}", (ONT + "Account",),
        (Field("c_name", ONT + "name"), Field("c_mktsegment", ONT + "segment"),
         Field("c_acctbal", ONT + "balance", XSD + "decimal")),
        (Link(ONT + "inNation", RES + "nation/{c_nationkey}"),)),
    "supplier": RowMapping(
        RES + "supplier/{s_suppkey}", (BANK,),
        (Field("s_name", ONT + "legalName"), Field("s_acctbal", ONT + "balance", XSD + "decimal")),
        (Link(ONT + "inNation", RES + "nation/{s_nationkey}"),)),
    "orders": RowMapping(
        RES + "order/{o_orderkey}", (ONT + "FinancialTransaction",),
        (Field("o_orderkey", ONT + "transactionId", XSD + "integer"),
         Field("o_totalprice", ONT + "amount", XSD + "decimal"),
         Field("o_orderstatus", ONT + "currency", values=CURRENCY),
         Field("o_orderdate", ONT + "timestamp", XSD + "dateTime"),
         Field("suspicious", ONT + "isSuspicious", XSD + "boolean")),
        (Link(ONT + "fromAccount", RES + "customer/{o_custkey}"),)),
}
# Subjects are made of primary keys.
MAPPINGS = {n: replace(m, unique=True) for n, m in MAPPINGS.items()}


def source(t, name: str) -> DataFrame:
    df = t[name]
    if name == "orders":
        df = df.withColumn("suspicious", F.col("o_orderpriority") == "1-URGENT")
    return df


def quads(t, *names: str, predicates=None, dealt: bool = False) -> DataFrame:
    """Quads of the named tables (all five without names), built lazily.

    ``dealt`` spreads the rows of the tables over tasks before they become quads, for plans that sort
    or hash all of them: a few MB of a file are a million rows.
    """
    rows = lambda n: deal(source(t, n), template(MAPPINGS[n].subject), rows=ROWS_TO_QUADS) if dealt else source(t, n)
    parts = [rows_to_triples(rows(n), MAPPINGS[n], graph_of(n), predicates) for n in names or MAPPINGS]
    return reduce(DataFrame.unionByName, parts)


def graph(t, *names: str):
    """The same quads as a function of the predicates wanted: patterns read the tables directly."""
    chosen = names or tuple(MAPPINGS)
    return mapped({n: source(t, n) for n in chosen}, {n: MAPPINGS[n] for n in chosen}, {n: graph_of(n) for n in chosen})


def _sql_quads(name: str) -> str:
    rows = {
        "region": [("type", f"'{ONT}Region'", "iri", None), (ONT + "name", "r_name", "literal", None)],
        "nation": [("type", f"'{ONT}Nation'", "iri", None), (ONT + "name", "n_name", "literal", None),
                   (ONT + "inRegion", f"'{RES}region/' || n_regionkey", "iri", None)],
        "customer": [("type", f"'{ONT}Account'", "iri", None), (ONT + "name", "c_name", "literal", None),
                     (ONT + "segment", "c_mktsegment", "literal", None),
                     (ONT + "balance", "CAST(c_acctbal AS VARCHAR)", "literal", "decimal"),
                     (ONT + "inNation", f"'{RES}nation/' || c_nationkey", "iri", None)],
        "supplier": [("type", f"'{BANK}'", "iri", None), (ONT + "legalName", "s_name", "literal", None),
                     (ONT + "balance", "CAST(s_acctbal AS VARCHAR)", "literal", "decimal"),
                     (ONT + "inNation", f"'{RES}nation/' || s_nationkey", "iri", None)],
        "orders": [("type", f"'{ONT}FinancialTransaction'", "iri", None),
                   (ONT + "transactionId", "CAST(o_orderkey AS VARCHAR)", "literal", "integer"),
                   (ONT + "amount", "CAST(o_totalprice AS VARCHAR)", "literal", "decimal"),
                   (ONT + "currency", "CASE o_orderstatus WHEN 'F' THEN 'EUR' WHEN 'O' THEN 'USD' WHEN 'P' THEN 'GBP' END",
                    "literal", None),
                   (ONT + "timestamp", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", "literal", "dateTime"),
                   (ONT + "isSuspicious", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END",
                    "literal", "boolean"),
                   (ONT + "fromAccount", f"'{RES}customer/' || o_custkey", "iri", None)],
    }
    key = {"region": "region/' || r_regionkey", "nation": "nation/' || n_nationkey",
           "customer": "customer/' || c_custkey", "supplier": "supplier/' || s_suppkey",
           "orders": "order/' || o_orderkey"}[name]
    out = []
    for p, o, kind, dt in rows[name]:
        p = vocab.TYPE if p == "type" else p
        d = "NULL" if dt is None else f"'{XSD}{dt}'"
        out.append(f"SELECT '{RES}{key} AS subject, '{p}' AS predicate, {o} AS object, '{kind}' AS object_kind, "
                   f"CAST({d} AS VARCHAR) AS datatype, CAST(NULL AS VARCHAR) AS lang, '{graph_of(name)}' AS graph FROM {name}")
    return " UNION ALL ".join(out)


def sql_quads(*names: str) -> str:
    """The same quads as a SQL query, written independently of the mappings."""
    return " UNION ALL ".join(_sql_quads(n) for n in names or MAPPINGS)
