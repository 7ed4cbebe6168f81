"""Best-fit packing of token pieces into sequences by the linear grouping scheme.

1. Every document becomes its token ids and an end id. A longer document than a
   sequence is cut into pieces, of which the first takes the remainder.
2. Pieces are counted by length: at most ``capacity`` numbers, whatever the input.
3. Large lengths are sorted and cut into groups of equal cardinality; within a group
   every length is rounded up to the largest. The few rounded sizes make a small
   linear program over configurations (how many of each size fill one sequence),
   solved by column generation with a knapsack, and rounded down.
4. Actual pieces take the places of the rounded ones, which frees what the rounding
   added. Pieces left over and small pieces follow, longest first, each into the
   sequence with the least room that still fits.

Steps 3 and 4 work on counts. They yield runs: "pieces of length L with ranks lo to hi
go to sequences base, base+1, ...". Executors rank the pieces of each length (in hash
buckets, so that a length that a third of all pieces have is no single task) and look
the run up. The plan grows with ``capacity`` only, never with the rows.

Defined results: a null text is empty and gives one piece with the end id; rows that
repeat an id are packed one by one; an empty table gives no pieces; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.columns import appended, read
from tallyframe.llm.scratch import stored
from tallyframe.llm.tokens import BYTE_BPE, encoder

CAPACITY = 1024
END_ID = 2
#: Groups of equal cardinality, and the shares of a sequence from which a piece is large:
#: a plan is made for each, and the one with the fewest sequences counts.
GROUPS = 192
LARGE_SHARES = (1 / 2, 1 / 3, 1 / 4)
#: Column generation: patterns kept of each pricing, and pricings at most (what it has found by then is valid).
PER_PRICING = 40
MAX_PRICINGS = 400
TOLERANCE = 1e-7
#: Hash buckets in which the pieces of one length are ranked.
BUCKETS = 256

PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


# Step 1: pieces


def cut_pieces(
    docs: DataFrame,
    tokenizer: str = BYTE_BPE,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece; with ``keep_ids`` also the ids, as little-endian 32-bit integers."""
    schema = PIECES_DDL + (", ids binary" if keep_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                start, number = 0, 0
                while start < n:
                    length = (n % capacity or capacity) if start == 0 else capacity
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, number, start, length, zlib.crc32(part), part)[: 5 + keep_ids])
                    start, number = start + length, number + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# Steps 2 to 4: the plan, made from counts by length


@dataclass
class Plan:
    """Runs (length, lo, hi, base): pieces of that length with ranks lo to hi-1 go to base onwards."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)
    free: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def open(self, n: int) -> tuple[int, int]:
        self.sequences += n
        return self.sequences - n, self.sequences

    def leave(self, room: int, lo: int, hi: int) -> None:
        if hi > lo:
            self.free.setdefault(room, []).append((lo, hi))


class Stock:
    """The pieces not yet placed, by length; taken from the lowest rank on."""

    def __init__(self, counts: dict[int, int]):
        self.left = {length: [0, n] for length, n in counts.items() if n}

    def take(self, length: int, n: int) -> tuple[int, int]:
        lo, hi = self.left[length]
        n = min(n, hi - lo)
        self.left[length][0] += n
        return lo, lo + n

    def count(self, length: int) -> int:
        lo, hi = self.left.get(length, (0, 0))
        return hi - lo


def group_sizes(counts: dict[int, int], large: int, groups: int) -> list[list[tuple[int, int]]]:
    """The large lengths in groups of equal cardinality, longest first: lists of (length, count)."""
    total = sum(n for length, n in counts.items() if length >= large)
    quota = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted((x for x in counts if x >= large), reverse=True):
        n = counts[length]
        while n:
            if room == 0:
                out.append([])
                room = quota
            part = min(n, room)
            out[-1].append((length, part))
            n, room = n - part, room - part
    return out


def best_patterns(sizes: np.ndarray, values: np.ndarray, capacity: int) -> list[np.ndarray]:
    """For every size, the configuration of most value that holds it and fits; ``sizes`` ascend.

    One unbounded knapsack serves all of them; they come in order of value, without repeats.
    """
    sizes_list = sizes.tolist()
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = 0
    for room in range(sizes_list[0], capacity + 1):
        while fits < len(sizes_list) and sizes_list[fits] <= room:
            fits += 1
        gain = best[room - sizes[:fits]] + values[:fits]
        i = int(gain.argmax())
        better = gain[i] > best[room - 1]
        best[room], choice[room] = (gain[i], i) if better else (best[room - 1], -1)
    total = best[capacity - sizes] + values
    out: dict[bytes, np.ndarray] = {}
    for first in np.argsort(-total)[:PER_PRICING].tolist():
        if total[first] <= 1 + TOLERANCE:
            break
        pattern = np.zeros(len(sizes), np.int64)
        pattern[first] += 1
        room = capacity - sizes_list[first]
        while room >= sizes_list[0]:
            if choice[room] < 0:
                room -= 1
            else:
                pattern[choice[room]] += 1
                room -= sizes_list[choice[room]]
        out.setdefault(pattern.tobytes(), pattern)
    return list(out.values())


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, in the relaxed cutting-stock program; ``sizes`` ascend."""
    size, need = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // size).astype(float))
    inverse = np.linalg.inv(basis)
    for turn in range(MAX_PRICINGS):
        found = best_patterns(size, inverse.sum(0), capacity)
        if not found:
            break
        for pattern in found:
            step = inverse @ pattern
            if step.sum() <= 1 + TOLERANCE:  # no longer worth more than a sequence
                continue
            level = np.maximum(inverse @ need, 0)
            ratio = np.where(step > TOLERANCE, level / np.where(step > TOLERANCE, step, 1), np.inf)
            out = int(ratio.argmin())
            basis[:, out] = pattern
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
        if turn % 20 == 19:  # rounding errors of the updates do not add up
            inverse = np.linalg.inv(basis)
    level = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(np.int64), float(level[j])) for j in range(len(sizes)) if level[j] > 0]


def make_plan(
    counts: dict[int, int],
    capacity: int = CAPACITY,
    groups: int = GROUPS,
    large_shares: tuple[float, ...] = LARGE_SHARES,
) -> Plan:
    plans = [_plan(counts, capacity, groups, max(1, int(capacity * x))) for x in large_shares]
    return min(plans, key=lambda plan: plan.sequences)


def _plan(counts: dict[int, int], capacity: int, groups: int, large: int) -> Plan:
    plan, stock = Plan(capacity), Stock(counts)
    if full := stock.count(capacity):
        base, _ = plan.open(full)
        plan.runs.append((capacity, *stock.take(capacity, full), base))
    rest = {length: n for length, n in counts.items() if length < capacity and n}
    if grouped := group_sizes(rest, large, groups):
        _place_large(plan, stock, grouped)
    for length in sorted(rest, reverse=True):
        _best_fit(plan, stock, length)
    return plan


def _place_large(plan: Plan, stock: Stock, grouped: list[list[tuple[int, int]]]) -> None:
    # A length may close one group and open the next; each group takes its own share of it.
    left = [[list(x) for x in g] for g in grouped]
    sizes, demand = [g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped]
    merged: dict[int, int] = {}
    for s, d in zip(sizes, demand, strict=True):
        merged[s] = merged.get(s, 0) + d
    members = {s: [g for g, size in zip(left, sizes, strict=True) if size == s] for s in merged}
    order = sorted(merged)
    for pattern, level in configurations(order, [merged[s] for s in order], plan.capacity):
        copies = int(level + 1e-6)
        if not copies:
            continue
        lo, hi = plan.open(copies)
        parts = [(lo, hi, plan.capacity)]
        for size, times in zip(order[::-1], pattern.tolist()[::-1], strict=True):
            for _ in range(times):
                parts = _fill(plan, stock, members[size], parts)
        for a, b, room in parts:
            plan.leave(room, a, b)


def _fill(plan: Plan, stock: Stock, groups: list, parts: list[tuple[int, int, int]]) -> list:
    """One more piece of a rounded size for every sequence of ``parts``, while there are any."""
    out = []
    for lo, hi, room in parts:
        while lo < hi:
            source = next((x for g in groups for x in g if x[1]), None)
            if source is None:
                out.append((lo, hi, room))
                break
            n = min(hi - lo, source[1])
            a, b = stock.take(source[0], n)
            plan.runs.append((source[0], a, b, lo))
            source[1] -= n
            out.append((lo, lo + n, room - source[0]))
            lo += n
    return out


def _best_fit(plan: Plan, stock: Stock, length: int) -> None:
    """All that is left of one length, each into the sequence with the least room that fits."""
    while n := stock.count(length):
        room = min((r for r, parts in plan.free.items() if r >= length and parts), default=None)
        if room is None:
            plan.leave(plan.capacity, *plan.open(-(-n // (plan.capacity // length))))
            continue
        lo, hi = plan.free[room].pop()
        a, b = stock.take(length, hi - lo)
        plan.runs.append((length, a, b, lo))
        plan.leave(room - length, lo, lo + b - a)
        plan.leave(room, lo + b - a, hi)


# Placing the rows


def ranked(pieces: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``pieces`` with their rank among those of the same length, from 0 without gaps."""
    order = ["doc_id", "piece", "start", "ids_crc32"]
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "bucket").count()  # at most capacity x buckets rows
    before = F.sum("count").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    return (
        rows.withColumn("inner", inner)
        .join(sizes, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inner") - 1)
        .drop("bucket", "inner", "before")
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read three times: pass a stored table."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = sorted(make_plan(counts, capacity, groups).runs)
    table = np.array(runs, np.int64).reshape(-1, 4)
    shift = 1 << 48  # ranks stay below it
    keys = table[:, 0] * shift + table[:, 1]

    def place(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        key = batch.column("length").to_numpy(zero_copy_only=False) * shift + rank
        run = np.searchsorted(keys, key, side="right") - 1
        return {"sequence_id": pa.array(table[run, 3] + rank - table[run, 1], pa.int64())}

    placed = appended(ranked(pieces), "sequence_id long", place).drop("rank")
    order = Window.partitionBy("sequence_id").orderBy(
        F.desc("length"), "doc_id", "piece", "start", "ids_crc32"
    )
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(offset, F.lit(0)))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that kept their ids: sequence_id, ids, n_tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # A sequence holds at most ``capacity`` ids, so this group is bounded.
    joined = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))")
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
        .select("sequence_id", joined.alias("ids"), "n_tokens")
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(stored(cut_pieces(docs), "pieces"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
