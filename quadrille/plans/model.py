"""The supplied tables described as entities, and the metrics used in the plans."""

from __future__ import annotations

from quadrille.operators.metrics import Dimension, EntitySpec, MetricContext, MetricSpec, Model, PropertySpec

P = PropertySpec

MODEL = Model.of(
    EntitySpec("Region", "region", (
        P("region_key", "r_regionkey", "integer", nullable=False),
        P("name", "r_name"),
    )),
    EntitySpec("Nation", "nation", (
        P("nation_key", "n_nationkey", "integer", nullable=False),
        P("name", "n_name"),
        P("region", "n_regionkey", "integer", references=("Region", "region_key")),
    )),
    EntitySpec("Customer", "customer", (
        P("customer_key", "c_custkey", "integer", nullable=False),
        P("name", "c_name"),
        P("segment", "c_mktsegment"),
        P("balance", None, "decimal(18,4)", contexts={
            "risk": "c_acctbal", "finance": "CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END"}),
        P("nation", "c_nationkey", "integer", references=("Nation", "nation_key")),
    )),
    EntitySpec("Supplier", "supplier", (
        P("supplier_key", "s_suppkey", "integer", nullable=False),
        P("name", "s_name"),
        P("nation", "s_nationkey", "integer", references=("Nation", "nation_key")),
    )),
    EntitySpec("Part", "part", (
        P("part_key", "p_partkey", "integer", nullable=False),
        P("brand", "p_brand"),
        P("kind", "p_type"),
        P("size", "p_size", "integer"),
    )),
    EntitySpec("Order", "orders", (
        P("order_key", "o_orderkey", "integer", nullable=False),
        P("status", "o_orderstatus"),
        P("priority", "o_orderpriority"),
        P("amount", "o_totalprice", "decimal(18,4)"),
        P("customer", "o_custkey", "integer", references=("Customer", "customer_key")),
    ), alias="o"),
    EntitySpec("Line", "lineitem", (
        P("amount", "l_extendedprice", "decimal(18,4)"),
        P("flag", "l_returnflag"),
        P("status", "l_linestatus"),
        P("part_key", "l_partkey", "integer", references=("Part", "part_key")),
        P("supplier_key", "l_suppkey", "integer", references=("Supplier", "supplier_key")),
        P("order_key", "l_orderkey", "integer", references=("Order", "order_key")),
    ), alias="t"),
)

# Lines reach a nation both through the supplier (two hops) and through the
# customer (three); the longer way has to be named.
BUYER_NATION = Dimension("buyer_nation", "Nation", "name", via=("order_key", "customer", "nation"))
BUYER = Dimension("buyer", "Customer", "name", via=("order_key", "customer"))
SELLER_NATION = Dimension("seller_nation", "Nation", "name")
SELLER_REGION = Dimension("seller_region", "Region", "name")

EXPOSURE = MetricSpec(
    "total_exposure", "sum", "Line", "amount",
    dimensions=(SELLER_NATION, SELLER_REGION, BUYER, BUYER_NATION, Dimension("brand", "Part", "brand")),
    contexts={
        "risk": MetricContext(filters=(
            {"field": "Order.status", "operator": "IN", "value": ["O", "P"]},
            {"field": "amount", "operator": ">", "value": 0})),
        "finance": MetricContext(filter="t.l_linestatus = 'F'", filters=(
            {"field": "flag", "operator": "!=", "value": "R"},), extra_dimensions=("flag",)),
    },
    time_grains=("day", "week", "month", "quarter", "year"),
    time_column="l_shipdate",
)
