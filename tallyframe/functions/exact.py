"""Exact sums of amounts that carry a fixed number of decimals.

A sum of doubles depends on the order in which tasks finish, and drifts as rows
grow. A decimal sum is exact but roughly twice as slow. Here an amount becomes a
whole number of its smallest unit, held as two bigints (``high * 10**6 + low``)
that are summed apart.

An amount with more decimals than declared, NaN, infinity, and an amount or product
beyond the bigint range raise an error that names the column and the value, with
``spark.sql.ansi.enabled`` on or off; nulls pass.

Limits, in currency units. One row: with two decimals in each factor, a price times a
share stays in range for prices below 9.2 * 10**14. Sums: ``low`` holds 9 * 10**12
rows of one group whatever the amounts; ``high`` holds as many for products below 10**8
(10**12 units of four decimals), and ten times fewer for products ten times larger.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = 1_000_000


def to_units(amount: Column, decimals: int, name: str = "amount") -> Column:
    """The double as a whole number of ``10**-decimals``; raises where it is not one."""
    units = F.rint(amount * 10**decimals).try_cast("bigint")
    message = F.concat(
        F.lit(f"{name} is not a number of at most {decimals} decimals: "), amount.cast("string")
    )
    return F.when(amount.isNull() | (units / 10**decimals == amount), units).otherwise(
        F.raise_error(message).cast("bigint")
    )


def product(units: Column, share: Column, name: str = "product") -> Column:
    """The product of two whole numbers; raises where it leaves the bigint range."""
    out = F.try_multiply(units, share)
    message = F.concat(F.lit(f"{name} is out of range: "), units.cast("string"))
    return F.when(out.isNotNull() | units.isNull() | share.isNull(), out).otherwise(
        F.raise_error(message).cast("bigint")
    )


def high_part(units: Column) -> Column:
    return F.call_function("div", units, F.lit(LOW))


def low_part(units: Column) -> Column:
    return units % LOW


def from_parts(high: Column, low: Column, decimals: int) -> Column:
    """The summed parts as one double, rounded once; exact for up to six decimals."""
    units = high.cast("decimal(38,0)") * LOW + low
    return (units / 10**decimals).cast("double")
