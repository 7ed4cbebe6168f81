"""Revenue by nation: line items joined to orders, customers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.exact import from_parts, high_part, low_part, product, to_units
from tallyframe.operators.rollup_sums import carry, sum_by
from tallyframe.sources.tables import read_table

# Prices and discounts carry two decimals each, so their product carries four.
CENTS = 2
REVENUE_DECIMALS = 4
SUMS = ("high", "low", "n_items")


def revenue_by_nation_of(
    lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame
) -> DataFrame:
    price = to_units(F.col("l_extendedprice"), CENTS, "l_extendedprice")
    share = F.try_subtract(F.lit(10**CENTS), to_units(F.col("l_discount"), CENTS, "l_discount"))
    units = product(price, share, "l_extendedprice * (1 - l_discount)")
    items = lineitem.select("l_orderkey", units.alias("units")).select(
        "l_orderkey",
        high_part(F.col("units")).alias("high"),
        low_part(F.col("units")).alias("low"),
        F.lit(1).cast("bigint").alias("n_items"),
    )
    by_customer = carry(items, "l_orderkey", SUMS, orders, "o_orderkey", "o_custkey")
    by_nation = carry(by_customer, "o_custkey", SUMS, customer, "c_custkey", "c_nationkey")
    by_name = carry(by_nation, "c_nationkey", SUMS, nation, "n_nationkey", "n_name")
    return sum_by(by_name, "n_name", SUMS).select(
        "n_name",
        from_parts(F.col("high"), F.col("low"), REVENUE_DECIMALS).alias("revenue"),
        "n_items",
    )


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revenue_by_nation_of(
        *[read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation")]
    )


REVENUE_BY_NATION_SQL = """
SELECT n_name,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(15, 2))
                * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue,
       count(*) AS n_items
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name
"""
