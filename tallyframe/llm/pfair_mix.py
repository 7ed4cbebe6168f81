"""Mixing sources to target weights by Pfair scheduling.

Each stream (a source, or all small sources together) is cut into blocks of equal bytes,
``slots`` blocks for all bytes. With weight w, block i of a stream may not start before slot
floor(i / w) and is due by slot ceil((i + 1) / w); in every slot the released block with the
earliest deadline goes next. As the weights add up to one, all deadlines are met, and at
every slot each stream is less than one block from its share, which is less than one part in
``slots`` of the mix.

Weights are exact fractions; none is rounded, so a stream of one row among many gigabytes
does not run out before its time. The slots of the blocks (not of rows) are made on the
driver: ``slots`` of them, whatever the size of the data, in the same way at every size.
Which block a row is in follows from a running sum over its stream in hash order, taken in
two levels (within hash buckets, and over the sums of the buckets), so that a source of a
third of all rows is no single task.

The mix ends where the first stream runs out: a block is in the mix (``in_mix``) if its
start, i / w, lies before that of the first block that some stream lacks. Rows behind it
have no slot. Where the weights are the streams' own shares, all rows are in the mix.

Target weights come from the caller, or from ``capped_weights``: every source with ``least``
of the bytes is a stream (at most 1/least are) with its share, but no more than ``cap``; all
smaller sources form one stream with theirs. Only the proportions count, so where the others
are few, a source gets more than ``cap`` of the mix.

Defined results: a null source is a source of its own; a null text counts one byte, as an
empty one; rows that repeat an id are placed one by one; a stream without rows is left
out, and one with rows needs a weight above 0; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.columns import read
from tallyframe.llm.scratch import stored

SLOTS = 4096
CAP, LEAST = 0.25, 0.01
#: Leading hexadecimal digits of the hash that name a bucket of the running sums.
BUCKET_DIGITS = 3

Block = tuple[int, int, int, int, int]


def scheduled(weights: list[int], blocks: list[int]) -> list[Block]:
    """(stream, block, release, deadline, slot) of every block in the mix, in order of slot.

    Only the proportions of ``weights`` count. ``blocks`` are the streams' numbers of blocks.
    """
    total = sum(weights)
    # Block i of a stream starts at i / w; the mix ends at the first such start of a block that is not there.
    end = min(Fraction(n * total, w) for n, w in zip(blocks, weights, strict=True))
    missing = sum(-(-w * end // total) for w in weights)
    waiting = [(0, s, 0) for s in range(len(weights))]  # release, stream, block
    released: list[tuple[int, int, int, int]] = []  # deadline, stream, block, release
    out: list[Block] = []
    slot = 0
    while len(out) < missing:
        while waiting and waiting[0][0] <= slot:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(i + 1) * total // weights[s]), s, i, release))
        deadline, s, i, release = heapq.heappop(released)
        if i * total < end * weights[s]:
            out.append((s, i, release, deadline, slot))
        heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))
        slot += 1
    return out


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def capped_weights(docs: DataFrame, cap: float = CAP, least: float = LEAST) -> tuple[list, list[int]]:
    """The sources that are streams, and the weights of these and, last, of all others, in bytes."""
    sizes = docs.groupBy("source").agg(F.sum(size_of(F.col("text"))).alias("size"))
    sizes = stored(sizes, "sources")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    named = sizes.where(F.col("size") >= least * total).collect()  # at most 1 / least rows
    named.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    rest = total - sum(r["size"] for r in named)
    most = int(Fraction(cap).limit_denominator(10**6) * total)
    return [r["source"] for r in named], [max(1, min(x, most)) for x in [*(r["size"] for r in named), rest]]


def stream_of(named: list) -> Column:
    """The place of a row's source among the named ones, or behind them."""
    out = F.lit(len(named))
    if there := [x for x in named if x is not None]:
        number = {x: i for i, x in enumerate(named)}
        at = F.create_map(*[F.lit(v) for x in there for v in (x, number[x])])[F.col("source")]
        out = F.coalesce(at, out)
    if None in named:
        out = F.when(F.col("source").isNull(), named.index(None)).otherwise(out)
    return out.cast("int")


def order_key() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))


PLAN = "stream int, block long, release long, deadline long, slot long"


def schedule(docs: DataFrame, named: list, weights: list, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, stream, block, release, deadline, slot, in_mix of every row, and its order key."""
    rows = docs.select(
        "doc_id",
        "source",
        stream_of(named).alias("stream"),
        order_key().alias("key"),
        F.xxhash64("text").alias("tie"),
        size_of(F.col("text")).alias("size"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    rows = stored(rows, "mixed")
    sums = rows.groupBy("stream", "bucket").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("stream").orderBy("bucket")  # at most 16**BUCKET_DIGITS rows each
    before = F.coalesce(
        F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    sums = stored(sums.select("stream", "bucket", "size", before.alias("bucket_before")), "sums")
    totals = {r["stream"]: r["size"] for r in sums.groupBy("stream").agg(F.sum("size").alias("size")).collect()}
    there = [(s, Fraction(w)) for s, w in enumerate(weights) if s in totals]
    spark = docs.sparkSession
    block_bytes, made = 1, []
    if there:
        if min(w for _, w in there) <= 0:
            raise ValueError(f"streams with rows need weights above 0: {weights}")
        block_bytes = -(-sum(totals.values()) // slots)
        scale = math.lcm(*(w.denominator for _, w in there))
        whole = [int(w * scale) for _, w in there]
        made = scheduled(whole, [-(-totals[s] // block_bytes) for s, _ in there])
        made = [(there[s][0], *rest) for s, *rest in made]
    # No more than ``slots`` rows and one for each stream.
    plan = F.broadcast(spark.createDataFrame(made, PLAN))
    inner = F.coalesce(
        F.sum("size").over(
            Window.partitionBy("stream", "bucket")
            .orderBy("key", "tie")
            .rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    placed = (
        rows.withColumn("inner_before", inner)
        .join(sums.drop("size"), ["stream", "bucket"])
        .withColumn("block", F.expr(f"(inner_before + bucket_before) div {block_bytes}"))
        .join(plan, ["stream", "block"], "left")
    )
    return placed.select(
        "doc_id",
        "source",
        "stream",
        "block",
        "release",
        "deadline",
        "slot",
        F.col("slot").isNotNull().alias("in_mix"),
        "key",
        "tie",
    )


def keep_mixed(docs: DataFrame, cap: float = CAP) -> DataFrame:
    """The rows of ``docs`` in the mix. No text is moved: in hash order, a stream's rows in the mix come first."""
    named, weights = capped_weights(docs, cap)
    placed = schedule(docs, named, weights)
    ends = placed.where("in_mix").groupBy("stream").agg(F.max(F.struct("key", "tie")).alias("end"))
    ends = F.broadcast(stored(ends, "ends"))  # a row for each stream
    marked = docs.select(
        F.struct("*").alias("row"),
        stream_of(named).alias("stream"),
        F.struct(order_key().alias("key"), F.xxhash64("text").alias("tie")).alias("at"),
    )
    return marked.join(ends, "stream").where(F.col("at") <= F.col("end")).select("row.*")


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return schedule(docs, *capped_weights(docs)).drop("key", "tie")


OP4_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k,
         CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size
  FROM documents
), total AS (
  SELECT CAST(sum(size) AS BIGINT) AS t, CAST((sum(size) + {SLOTS - 1}) // {SLOTS} AS BIGINT) AS block_bytes FROM sized
), named AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS stream
  FROM sized, total GROUP BY source, t HAVING sum(size) >= {LEAST} * t
), placed AS (
  SELECT doc_id, s.source, coalesce(n.stream, (SELECT count(*) FROM named)) AS stream, k, s.size
  FROM sized s LEFT JOIN named n ON s.source IS NOT DISTINCT FROM n.source
), blocks AS (
  SELECT doc_id, source, stream,
         CAST(coalesce(sum(size) OVER (PARTITION BY stream ORDER BY k
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // block_bytes AS block
  FROM placed, total
), streams AS (
  SELECT stream, CAST(least(sum(size), CAST(floor(t * {CAP}) AS BIGINT)) AS HUGEINT) AS w,
         CAST((sum(size) + any_value(block_bytes) - 1) // any_value(block_bytes) AS HUGEINT) AS n,
         row_number() OVER (ORDER BY stream) AS place
  FROM placed, total GROUP BY stream, t
), lists AS (
  SELECT list(stream ORDER BY stream) AS ids, list(w ORDER BY stream) AS w, CAST(sum(w) AS HUGEINT) AS all_w,
         -- the stream that runs out first, at n / w
         arg_min(n, CAST(n AS DOUBLE) / w) AS end_n, arg_min(w, CAST(n AS DOUBLE) / w) AS end_w
  FROM streams
), needed AS (
  SELECT CAST(sum((end_n * s.w + end_w - 1) // end_w) AS BIGINT) AS missing FROM streams s, lists
), turns(t, c, pick, made) AS (
  SELECT 0, list_transform(w, lambda x: CAST(0 AS BIGINT)), 0, CAST(0 AS BIGINT) FROM lists
  UNION ALL
  SELECT t + 1, list_transform(c, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), CAST(p AS INTEGER),
         made + CASE WHEN c[p] * end_w < end_n * w[p] THEN 1 ELSE 0 END
  FROM (
    SELECT t, c, w, made, end_n, end_w, list_position(d, list_min(d)) AS p
    FROM (
      SELECT t, c, w, made, end_n, end_w,
             list_transform(w, lambda x, i:
               CASE WHEN c[i] * all_w // x <= t THEN ((c[i] + 1) * all_w + x - 1) // x
               ELSE CAST(1000000000000 AS HUGEINT) END) AS d
      FROM turns, lists, needed WHERE made < missing
    )
  )
), slots AS (
  SELECT ids[pick] AS stream, c[pick] - 1 AS block, t - 1 AS slot, w[pick] AS w, all_w
  FROM turns, lists WHERE t > 0 AND (c[pick] - 1) * end_w < end_n * w[pick]
)
SELECT doc_id, source, CAST(b.stream AS INTEGER) AS stream, b.block,
       CAST(b.block * all_w // w AS BIGINT) AS release,
       CAST(((b.block + 1) * all_w + w - 1) // w AS BIGINT) AS deadline,
       CAST(slot AS BIGINT) AS slot, slot IS NOT NULL AS in_mix
FROM blocks b LEFT JOIN slots s ON s.stream = b.stream AND s.block = b.block
"""
