import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions.exact import from_parts, high_part, low_part, product, to_units


@pytest.fixture(params=["true", "false"], ids=["ansi", "no ansi"], autouse=True)
def ansi(spark, request):
    setting = "spark.sql.ansi.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, request.param)
    yield
    spark.conf.set(setting, before)


def exact_total(df, column, decimals):
    units = df.select(to_units(F.col(column), decimals).alias("u"))
    sums = units.agg(
        F.sum(high_part(F.col("u"))).alias("h"), F.sum(low_part(F.col("u"))).alias("l")
    )
    return sums.select(from_parts(F.col("h"), F.col("l"), decimals).alias("t")).first()["t"]


def test_total_equals_a_decimal_sum_for_either_sign(spark):
    rng = random.Random(7)
    amounts = [round(rng.uniform(-1e6, 1e6), 2) for _ in range(5000)]
    df = spark.createDataFrame([(a,) for a in amounts], "a double").repartition(7)
    assert exact_total(df, "a", 2) == float(sum(Decimal(str(a)) for a in amounts))


def test_order_of_rows_does_not_change_the_total(spark):
    amounts = [1e13 + 0.01, 0.01, -1e13, 0.1, 0.2]
    totals = {
        exact_total(spark.createDataFrame([(a,) for a in order], "a double").coalesce(1), "a", 2)
        for order in (amounts, amounts[::-1], sorted(amounts))
    }
    assert totals == {0.32}


def test_parts_hold_sums_beyond_one_bigint(spark):
    # 10**11 rows of 10**9 units each are 10**20, past the bigint range of 9.2 * 10**18.
    row = spark.range(1).select(
        from_parts(F.lit(10**3 * 10**11), F.lit(123_456 * 10**11), 4).alias("t")
    )
    expected = Decimal(10**3 * 10**11 * 10**6 + 123_456 * 10**11) / 10**4
    assert row.first()["t"] == float(expected)


def test_null_amounts_are_skipped_and_an_all_null_sum_is_null(spark):
    df = spark.createDataFrame([(None,), (1.25,)], "a double")
    assert exact_total(df, "a", 2) == 1.25
    assert exact_total(df.where("a IS NULL"), "a", 2) is None


@pytest.mark.parametrize(
    "amount", [0.125, 10.005, 0.004, float("nan"), float("inf"), -float("inf"), 1e18, -1e18]
)
def test_an_amount_that_two_decimals_cannot_hold_raises(spark, amount):
    df = spark.createDataFrame([(amount,)], "a double").select(to_units(F.col("a"), 2, "price"))
    with pytest.raises(Exception, match="price is not a number of at most 2 decimals"):
        df.collect()


def test_amounts_of_two_decimals_and_nulls_pass(spark):
    df = spark.createDataFrame([(1.25,), (None,), (0.07,), (-3.0,), (92e12 + 0.5,)], "a double")
    units = [r[0] for r in df.select(to_units(F.col("a"), 2)).collect()]
    assert units == [125, None, 7, -300, 9_200_000_000_000_050]


def test_the_limit_of_one_product(spark):
    of = lambda price, share: spark.range(1).select(
        product(F.lit(price).cast("bigint"), F.lit(share).cast("bigint")).alias("p")
    )
    assert of(92_233_720_368_547_758, 100).first()["p"] == 9_223_372_036_854_775_800
    with pytest.raises(Exception, match="product is out of range"):
        of(92_233_720_368_547_759, 100).collect()
    assert of(None, 100).first()["p"] is None
