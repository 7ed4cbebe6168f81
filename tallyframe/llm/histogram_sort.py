"""Sharding by histogram sort: exact bytes below candidate boundaries, then one exchange.

Rows are ordered by the hash of their text and then by doc_id, so equal texts stand
together and a group of copies can still be cut. The boundaries that give every shard
the same bytes are found by counting: each round counts, across all partitions, the
exact bytes and rows between candidate keys (probes), and places new probes only inside
the intervals that still hold a boundary, shrunk to the keys that are really there. It
ends when every boundary is within its tolerance or falls into the rows of one key.
Only then the texts move, once, to the range that their key is in.

Counting reads a stored table of keys and sizes; what a round returns is bounded by the
number of probes. A shard larger than ``range_bytes`` is cut into several ranges by the
same counting (at most ``max_ranges`` in all), so that no task sorts a whole shard; the
exact row counts below the boundaries make the slots of a shard gapless across its ranges.

Defined results: a null text has no bytes (size 16) and a null doc_id sorts first; rows
that repeat doc_id and text have one key and stay in one shard, next to each other; an
empty table gives no rows. Columns of the input named shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyframe.llm.columns import free_name, read
from tallyframe.llm.scratch import stored

SHARDS = 40
ROW_BYTES = 16
#: Of a shard's ideal bytes, what a boundary may be off; ranges inside a shard may be further off.
TOLERANCE = 0.001
RANGE_TOLERANCE = 0.05
RANGE_BYTES = 128 << 20
MAX_RANGES = 4000
PROBES = 16

HALF = 1 << 63
WORD = 1 << 64
KEYS_END = WORD * WORD


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def key_columns() -> tuple[Column, Column]:
    return F.xxhash64("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-HALF))


def as_number(high: int, low: int) -> int:
    """A key of two signed words as one number in the same order."""
    return (high + HALF) * WORD + low + HALF


def as_words(key: int) -> tuple[int, int]:
    return key // WORD - HALF, key % WORD - HALF


class Boundaries:
    """Sorted keys; ``find`` gives for each row how many of them are at or below its key."""

    def __init__(self, keys: list[int]):
        words = [as_words(k) for k in keys]
        self.high = np.array([h for h, _ in words], np.int64)
        self.low = np.array([x for _, x in words], np.int64)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        start = np.searchsorted(self.high, high, side="left")
        end = np.searchsorted(self.high, high, side="right")
        out = start.copy()
        for i in np.unique(start[start < end]):  # boundaries within one text hash are few
            at = np.flatnonzero((start == i) & (end > i))
            out[at] = i + np.searchsorted(self.low[i : end[at[0]]], low[at], side="right")
        return out


@dataclass
class Interval:
    """Where one boundary is still sought: keys from ``first`` to ``last``, and what lies below ``first``."""

    goal: float
    tolerance: float
    first: int
    last: int
    found: tuple[int, int] | None = None  # boundary key, rows below it


def count_between(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int]]:
    """Per interval between probes: bytes, rows, first and last key."""
    find = Boundaries(probes).find
    names = ["interval", "size", "n", "first_h", "first_l", "last_h", "last_l"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low", "size"))
            order = np.lexsort((low, high))
            high, low, size = high[order], low[order], size[order]
            at = find(high, low)
            if not len(at):
                continue
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            last = np.append(first[1:], len(at)) - 1
            columns = [
                at[first], np.add.reduceat(size, first), last - first + 1,
                high[first], low[first], high[last], low[last],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    rows = (
        keys.mapInArrow(run, ", ".join(f"{n} long" for n in names))
        .groupBy("interval")
        .agg(
            F.sum("size").alias("size"),
            F.sum("n").alias("n"),
            F.min(F.struct("first_h", "first_l")).alias("first"),
            F.max(F.struct("last_h", "last_l")).alias("last"),
        )
        .collect()
    )
    out = [(0, 0, 0, 0)] * (len(probes) + 1)
    for r in rows:
        out[r["interval"]] = (r["size"], r["n"], as_number(*r["first"]), as_number(*r["last"]))
    return out


def find_boundaries(keys: DataFrame, goals: list[tuple[float, float]], probes_each: int = PROBES):
    """A boundary key and the rows below it for every (bytes below, tolerance)."""
    open_ = [Interval(g, t, 0, KEYS_END - 2) for g, t in goals]
    all_ = list(open_)
    while open_:
        probes: set[int] = set()
        for x in open_:
            width = x.last + 1 - x.first  # the probe behind the last key closes the interval
            n = min(probes_each, width)
            probes.update(x.first + width * (i + 1) // n for i in range(n))
        ordered = sorted(probes)
        counted = count_between(keys, ordered)
        below_bytes = np.cumsum([0] + [c[0] for c in counted])
        below_rows = np.cumsum([0] + [c[1] for c in counted])
        left = []
        for x in open_:
            # Interval i lies below probe i and holds the goal.
            i = int(np.searchsorted(below_bytes[1:], x.goal, side="right"))
            i = min(i, len(counted) - 1)
            ends = [(0, 0, 0)] if i == 0 else [(ordered[i - 1], below_bytes[i], below_rows[i])]
            ends.append((ordered[i] if i < len(ordered) else KEYS_END - 1, below_bytes[i + 1], below_rows[i + 1]))
            key, size, rows = min(ends, key=lambda e: abs(e[1] - x.goal))
            _, n, first, last = counted[i]
            if abs(size - x.goal) <= x.tolerance or n == 0 or first == last:
                x.found = (key, int(rows))
            else:
                x.first, x.last = first, last
                left.append(x)
        open_ = left
    return [x.found for x in all_]


def shard_by_bytes(
    docs: DataFrame,
    shards: int = SHARDS,
    range_bytes: int = RANGE_BYTES,
    max_ranges: int = MAX_RANGES,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``docs`` with shard (0 to shards-1, sizes near equal) and slot (its place there)."""
    high, low = key_columns()
    docs = docs.drop("shard", "slot")
    keys = stored(docs.select(high.alias("high"), low.alias("low"), size_of(F.col("text")).alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(-(-total // (shards * range_bytes)), max_ranges // shards))
    ideal = total / shards
    goals = [
        (ideal * i / parts, ideal * (tolerance if i % parts == 0 else RANGE_TOLERANCE / parts))
        for i in range(1, shards * parts)
    ]
    found = find_boundaries(keys, goals) if total else [(KEYS_END - 1, 0)] * len(goals)
    found = sorted(found)
    starts = [0] + [rows for _, rows in found]  # rows below each range
    offsets = np.array([starts[r] - starts[r // parts * parts] for r in range(shards * parts)])
    find = Boundaries([key for key, _ in found]).find

    @F.pandas_udf(IntegerType())
    def range_of(h: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(find(h.to_numpy(), x.to_numpy()).astype(np.int32))

    h, x, r = (free_name(docs.columns, c) for c in ("sort_high", "sort_low", "sort_range"))
    placed = docs.withColumns({h: high, x: low}).withColumn(r, range_of(h, x))
    moved = placed.repartitionById(shards * parts, F.col(r))
    place = F.row_number().over(Window.partitionBy(r).orderBy(h, x)) - 1
    first = F.element_at(F.lit(offsets.tolist()), F.col(r) + 1)
    return (
        moved.withColumn("slot", (place + first).cast("long"))
        .withColumn("shard", F.floor(F.col(r) / parts).cast("int"))
        .drop(h, x, r)
    )


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
