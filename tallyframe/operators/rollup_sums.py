"""Sums carried from key to key, so that no join meets more than one row per key.

Each step groups before it joins. Spark combines every group on the map side
first, so a key that holds a third of all rows reaches its shuffle as at most
one row per map task, and the join after it needs no salting. The join reuses
the partitioning of the grouping below it, so only the other side is shuffled
for it, and that side is broadcast only where Spark's own size check
(``spark.sql.autoBroadcastJoinThreshold``) allows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_by(df: DataFrame, key: str, sums: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])


def carry(
    df: DataFrame, key: str, sums: Sequence[str], lookup: DataFrame, lookup_key: str, to: str
) -> DataFrame:
    """Sums of ``df`` per ``key``, inner-joined to ``lookup`` and labelled with its ``to``.

    Rows whose key is null or missing from ``lookup`` drop out, and a key that
    ``lookup`` repeats counts once per repetition, as in a join of the raw rows.
    """
    grouped = sum_by(df, key, sums)
    return grouped.join(lookup, grouped[key] == lookup[lookup_key]).select(to, *sums)
