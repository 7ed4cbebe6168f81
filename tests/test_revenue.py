"""The query against a brute-force join, on rows made to be awkward, and its plan."""

import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest

from tallyframe.plans.revenue import revenue_by_nation, revenue_by_nation_of

SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
}


def hot_tables():
    """A third of all items on one order, of orders on one customer, of customers in one nation."""
    rng = random.Random(3)

    def hot(n):
        return 1 if rng.random() < 1 / 3 else rng.randrange(n)

    return {
        "lineitem": [
            (hot(400), round(rng.uniform(900, 105000), 2), rng.randrange(11) / 100)
            for _ in range(6000)
        ],
        "orders": [(k, hot(60)) for k in range(350)],
        "customer": [(k, hot(6)) for k in range(50)],
        "nation": [(k, f"N{k}") for k in range(5)],
    }


def awkward_tables():
    """Null and orphan keys, null amounts, repeated lookup keys and a shared nation name."""
    return {
        "lineitem": [
            (1, 100.10, 0.05),
            (1, None, 0.05),
            (2, 50.55, None),
            (3, 10.01, 0.0),
            (4, 7.77, 0.1),
            (None, 9.99, 0.1),
            (99, 9.99, 0.1),
        ],
        "orders": [(1, 10), (1, 11), (2, 12), (3, 11), (4, None), (None, 10), (5, 10)],
        "customer": [(10, 0), (11, 1), (11, 1), (12, 2), (None, 0), (13, 0)],
        "nation": [(0, "A"), (1, "A"), (2, "C"), (3, "D"), (None, "E")],
    }


def brute_force(tables):
    """Every matching combination of rows, one at a time, in decimals."""

    def index(rows):
        found = defaultdict(list)
        for key, value in rows:
            if key is not None:
                found[key].append(value)
        return found

    orders, customer, nation = (index(tables[t]) for t in ("orders", "customer", "nation"))
    totals = {}
    for key, price, discount in tables["lineitem"]:
        for custkey in orders.get(key, []):
            for nationkey in customer.get(custkey, []):
                for name in nation.get(nationkey, []):
                    revenue, items = totals.get(name, (None, 0))
                    if price is not None and discount is not None:
                        amount = Decimal(str(price)) * (1 - Decimal(str(discount)))
                        revenue = amount if revenue is None else revenue + amount
                    totals[name] = (revenue, items + 1)
    return {n: (None if r is None else float(r), i) for n, (r, i) in totals.items()}


def frames(spark, tables):
    return [spark.createDataFrame(tables[t], SCHEMAS[t]).repartition(5) for t in SCHEMAS]


@pytest.fixture(params=["10485760", "-1"], ids=["broadcast", "shuffle"])
def join_setting(spark, request):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, request.param)
    yield request.param
    spark.conf.set(setting, before)


@pytest.fixture(params=["true", "false"], ids=["ansi", "no ansi"])
def ansi(spark, request):
    setting = "spark.sql.ansi.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, request.param)
    yield
    spark.conf.set(setting, before)


@pytest.mark.parametrize(
    "price, discount",
    [(100.0, 0.125), (10.005, 0.0), (0.004, 0.0), (float("nan"), 0.0), (float("inf"), 0.0),
     (1e18, 0.0), (1e15, 0.0), (9.3e14, 0.0)],
)
def test_an_amount_that_cannot_be_exact_raises(spark, ansi, price, discount):
    tables = awkward_tables() | {"lineitem": [(3, 5.0, 0.0), (3, price, discount)]}
    with pytest.raises(Exception, match="decimals|out of range"):
        revenue_by_nation_of(*frames(spark, tables)).collect()


def test_a_price_just_below_the_limit_is_exact(spark, ansi):
    tables = awkward_tables() | {"lineitem": [(2, 9.2e14, 0.0)]}
    rows = revenue_by_nation_of(*frames(spark, tables)).collect()
    assert {r["n_name"]: (r["revenue"], r["n_items"]) for r in rows} == brute_force(tables)


@pytest.mark.parametrize("make", [hot_tables, awkward_tables])
def test_matches_brute_force(spark, join_setting, ansi, make):
    tables = make()
    rows = revenue_by_nation_of(*frames(spark, tables)).collect()
    assert {r["n_name"]: (r["revenue"], r["n_items"]) for r in rows} == brute_force(tables)
    assert len(rows) == len({r["n_name"] for r in rows})


def test_empty_input_gives_no_rows(spark):
    empty = {t: [] for t in SCHEMAS}
    assert revenue_by_nation_of(*frames(spark, empty)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_columns_used(spark):
    plan = plan_of(revenue_by_nation(spark, "/root/testdata/sf0.001"))
    assert sorted(re.findall(r"ReadSchema: (\S+)", plan)) == [
        "struct<c_custkey:bigint,c_nationkey:int>",
        "struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>",
        "struct<n_nationkey:int,n_name:string>",
        "struct<o_orderkey:bigint,o_custkey:bigint>",
    ]
    assert "Python" not in plan


def test_every_grouping_combines_before_its_shuffle(spark, join_setting):
    plan = plan_of(revenue_by_nation(spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"HashAggregate\(.*partial_sum\(high", plan)) == 4
    assert "SortAggregate" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # One shuffle of line items, reused by the join above it.
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 1
    if join_setting == "-1":
        assert "Broadcast" not in plan
        # Four groupings and one lookup side for each of the three joins.
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 7


def test_tables_bucketed_on_the_order_key_join_without_a_shuffle(spark, tmp_path):
    tables = hot_tables()
    lineitem, orders, customer, nation = frames(spark, tables)
    spark.sql("CREATE DATABASE bucketed")
    try:
        for name, df, key in (("lineitem", lineitem, "l_orderkey"), ("orders", orders, "o_orderkey")):
            writer = df.write.bucketBy(4, key).sortBy(key).option("path", f"{tmp_path}/{name}")
            writer.saveAsTable(f"bucketed.{name}")
        df = revenue_by_nation_of(
            spark.table("bucketed.lineitem"), spark.table("bucketed.orders"), customer, nation
        )
        assert not re.search(r"Exchange hashpartitioning\([lo]_orderkey", plan_of(df))
        rows = df.collect()
        assert {r["n_name"]: (r["revenue"], r["n_items"]) for r in rows} == brute_force(tables)
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_hot_order_reaches_its_shuffle_as_one_row_per_map_task(spark):
    tables = hot_tables()
    hot_only = {**tables, "lineitem": [r for r in tables["lineitem"] if r[0] == 1]}
    assert len(hot_only["lineitem"]) > 1900
    items = spark.createDataFrame(hot_only["lineitem"], SCHEMAS["lineitem"]).repartition(5)
    others = frames(spark, hot_only)[1:]
    df = revenue_by_nation_of(items, *others)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    written = exchange_rows(plan, "hashpartitioning(l_orderkey")
    assert written == [5]


@pytest.mark.parametrize("join_setting", ["-1"], indirect=True)
@pytest.mark.parametrize("key", ["o_custkey", "c_nationkey"])
def test_hot_customer_and_nation_are_combined_before_their_shuffle(spark, join_setting, key):
    tables = hot_tables()
    if key == "o_custkey":  # every order is of one customer
        tables["orders"] = [(k, 1) for k, _ in tables["orders"]]
    else:  # every customer is in one nation
        tables["customer"] = [(k, 1) for k, _ in tables["customer"]]
    df = revenue_by_nation_of(*frames(spark, tables))
    df.collect()
    written = exchange_rows(df._jdf.queryExecution().executedPlan(), f"hashpartitioning({key}")
    assert len(written) == 1
    assert 1 <= written[0] <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def exchange_rows(plan, marker):
    """Rows written by each executed shuffle whose partitioning starts with ``marker``."""
    found = []
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            stack.append(node.plan())
        else:
            if name == "Exchange" and node.outputPartitioning().toString().startswith(marker):
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            children = node.children()
            stack.extend(children.apply(i) for i in range(children.size()))
    return found
