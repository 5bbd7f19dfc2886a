from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import metrics as M
from tests.conftest import rows

ACCOUNT = M.EntitySpec("Account", "accounts", (
    M.PropertySpec("id", "account_id", "integer", nullable=False), M.PropertySpec("kind", "account_type"),
    M.PropertySpec("owner", "legal_entity_id", "integer", references=("Party", "id")),
    M.PropertySpec("balance", None, "decimal", contexts={"risk": "eod_balance", "finance": "current_balance"})))
PARTY = M.EntitySpec("Party", "parties", (M.PropertySpec("id", "entity_id", "integer"), M.PropertySpec("name", "legal_name")))
PAYMENT = M.EntitySpec("Payment", "payments", (
    M.PropertySpec("amount", "amount", "decimal"), M.PropertySpec("currency", "currency"),
    M.PropertySpec("from_account", "account_from_id", "integer", references=("Account", "id")),
    M.PropertySpec("to_account", "account_to_id", "integer", references=("Account", "id"))), alias="t",
    contexts={"archive": "old_payments"})
MODEL = M.Model.of(ACCOUNT, PARTY, PAYMENT)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "parties": spark.createDataFrame([(1, "Ann"), (2, "Bo")], "entity_id int, legal_name string"),
        "accounts": spark.createDataFrame(
            [(10, "checking", 1, 5.0, 6.0), (11, "savings", 1, 7.0, 8.0), (12, "checking", 2, 1.0, 2.0)],
            "account_id int, account_type string, legal_entity_id int, eod_balance double, current_balance double"),
        "payments": spark.createDataFrame(
            [(10, 12, 5.5, "EUR", datetime(2024, 1, 31)), (11, 12, 4.5, "EUR", datetime(2024, 2, 1)),
             (12, 10, 7.0, "USD", datetime(2024, 2, 2)), (99, 10, 3.0, "O'Brien", datetime(2024, 3, 1)),
             (12, 11, None, None, datetime(2024, 3, 2))],
            "account_from_id int, account_to_id int, amount double, currency string, paid_at timestamp_ntz"),
        "old_payments": spark.createDataFrame([(10, 12, 100.0, "EUR", datetime(2020, 1, 1))],
                                              "account_from_id int, account_to_id int, amount double, currency string, paid_at timestamp_ntz"),
    }


def spec(kind="sum", **kw):
    return M.MetricSpec("value", kind, "Payment", kw.pop("measure", "amount"), **kw)


def values(df):
    return {tuple(r)[:-1]: r["value"] for r in df.collect()}


def test_two_hops_and_unmatched_keys(tables):
    owner = M.Dimension("owner", "Party", "name", via=("from_account", "owner"))
    got = values(M.metric(spec(dimensions=(owner,)), MODEL, tables))
    assert {k[0]: float(v) for k, v in got.items()} == {"Ann": 10.0, "Bo": 7.0, None: 3.0}


@pytest.mark.parametrize("kind,expected", [
    ("sum", {"checking": 12.5, "savings": 4.5, None: 3.0}), ("count", {"checking": 2, "savings": 1, None: 1}),
    ("avg", {"checking": 6.25, "savings": 4.5, None: 3.0}), ("min", {"checking": 5.5, "savings": 4.5, None: 3.0}),
    ("max", {"checking": 7.0, "savings": 4.5, None: 3.0})])
def test_partial_aggregates_equal_plain_ones(tables, kind, expected):
    d = M.Dimension("kind", "Account", "kind", via=("from_account",))
    got = values(M.metric(spec(kind, dimensions=(d,)), MODEL, tables))
    assert {k[0]: float(v) for k, v in got.items()} == {k: float(v) for k, v in expected.items()}


def test_count_distinct_across_keys(tables):
    # Two accounts of one owner send in one currency: it counts once.
    d = M.Dimension("owner", "Party", "name", via=("from_account", "owner"))
    got = values(M.metric(spec("count_distinct", measure="currency", dimensions=(d,)), MODEL, tables))
    assert got == {("Ann",): 1, ("Bo",): 1, (None,): 1}


def test_ambiguous_path_is_an_error(tables):
    with pytest.raises(M.JoinPathError):
        M.metric(spec(), MODEL, tables, ["Account.kind"])


def test_unreachable_entity_is_an_error(tables):
    with pytest.raises(M.JoinPathError):
        M.metric(M.MetricSpec("value", "count", "Party"), MODEL, tables, ["Payment.currency"])


def test_null_filter_list_filter_and_quotes(tables):
    count = spec("count", measure=None)
    assert M.metric(count, MODEL, tables, [], filters={"currency": None}).first()["value"] == 1
    assert M.metric(count, MODEL, tables, [], filters={"currency": ["EUR", "USD"]}).first()["value"] == 3
    assert M.metric(count, MODEL, tables, [], filters={"currency": "O'Brien"}).first()["value"] == 1
    with pytest.raises(TypeError):
        M.metric(count, MODEL, tables, [], filters={"currency": {"a": 1}})


def test_filter_on_a_joined_dimension(tables):
    d = M.Dimension("kind", "Account", "kind", via=("from_account",))
    got = M.metric(spec(dimensions=(d,)), MODEL, tables, [], filters={"kind": "savings"}).first()
    assert float(got["value"]) == 4.5


def test_period_and_dimension_are_both_grouped(tables):
    s = spec(time_grains=("month",), time_column="paid_at")
    got = M.metric(s, MODEL, tables, ["currency"], grain="month")
    assert got.columns == ["period", "currency", "value"]
    assert got.count() == 5
    # A grain the metric does not declare adds no period.
    assert M.metric(spec(), MODEL, tables, ["currency"], grain="month").columns == ["currency", "value"]


def test_end_date_means_its_midnight(tables):
    s = spec("count", time_column="paid_at", time_grains=("day",))
    assert M.metric(s, MODEL, tables, [], between=("2024-01-31", "2024-02-02")).first()["value"] == 3


def test_context_table_and_column(tables):
    assert float(M.metric(spec(contexts={"archive": M.MetricContext()}), MODEL, tables, []).first()["value"]) == 100.0
    s = M.MetricSpec("value", "sum", "Account", "balance", contexts={"risk": M.MetricContext(), "finance": M.MetricContext()})
    assert float(M.metric(s, MODEL, tables, [], context="finance").first()["value"]) == 16.0
    with pytest.raises(M.ContextAmbiguousError) as error:
        M.metric(s, MODEL, tables, [])
    assert error.value.contexts == ["finance", "risk"]
    with pytest.raises(M.ContextNotFoundError):
        M.metric(s, MODEL, tables, [], context="ops")


@pytest.mark.parametrize("bad", [
    dict(name="Value"), dict(type="median"), dict(time_grains=("month",)), dict(time_grains=("hour",), time_column="x"),
    dict(type="custom"), dict(type="latest")])
def test_spec_checks(bad):
    with pytest.raises(ValueError):
        M.MetricSpec(**{"name": "value", "type": "sum", "entity": "Payment", "measure": "amount", **bad})


def test_custom_over_a_join(tables):
    d = M.Dimension("kind", "Account", "kind", via=("from_account",))
    s = M.MetricSpec("value", "custom", "Payment", measure_sql="max(amount) - min(amount)", dimensions=(d,))
    assert values(M.metric(s, MODEL, tables))[("checking",)] == 1.5


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("amount"), (F.col("id") % 3).cast("string").alias("currency"),
                            F.lit(1).alias("account_from_id"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "p"))
    df = M.metric(spec(), MODEL, {"payments": spark.read.parquet(str(tmp_path / "p"))}, [], filters={"currency": "1"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(currency,1)" in plan and "unused" not in plan.split("ReadSchema")[1]


def test_followed_within_by_brute_force(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    stays = []
    for i in range(300):
        # One key holds a third of the rows.
        s = start + timedelta(days=rng.randrange(4000) if i % 3 else rng.randrange(9000))
        stays.append((i, 0 if i % 3 == 0 else rng.randrange(60), s, s + timedelta(days=rng.randrange(-2, 10))))
    df = spark.createDataFrame(stays, "id int, key int, s timestamp_ntz, e timestamp_ntz")
    got = [r["id"] for r in M.followed_within(df, "id", "key", "s", "e", 30).collect()]
    want = [a[0] for a in stays if any(b[1] == a[1] and b[0] != a[0] and a[3] <= b[2] <= a[3] + timedelta(days=30) for b in stays)]
    assert sorted(got) == sorted(want)


def test_followed_within_edges_in_one_shuffle(spark):
    rng = random.Random(3)
    day = datetime(2024, 3, 1)
    at = lambda: None if rng.random() < 0.05 else day + timedelta(hours=6 * rng.randrange(600))
    stays = []
    for i in range(400):
        # Rows without length, rows that end before they start, equal times, missing times and keys.
        s = at()
        stays.append((i, None if i % 40 == 7 else i % 5, s, s if i % 3 == 0 else at(), "payload"))
    df = spark.createDataFrame(stays, "id int, key int, s timestamp_ntz, e timestamp_ntz, more string")
    found = M.followed_within(df, "id", "key", "s", "e", 2)
    want = [a for a in stays if a[3] is not None and any(
        b[1] == a[1] is not None and b[0] != a[0] and b[2] is not None and a[3] <= b[2] <= a[3] + timedelta(days=2) for b in stays)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_resolve_requests(spark):
    catalogue = spark.createDataFrame([("one", "risk"), ("two", "risk"), ("two", "finance")], "metric string, context string")
    requests = spark.createDataFrame([(1, "one", None), (2, "two", None), (3, "two", "risk"), (4, "one", "nope"), (5, "zero", None)],
                                     "id int, metric string, context string")
    got = rows(M.resolve_requests(requests, catalogue), "id", "status", "context")
    assert got == [(1, "inferred", "risk"), (2, "ambiguous", None), (3, "resolved", "risk"), (4, "unknown_context", None), (5, "unknown", None)]
