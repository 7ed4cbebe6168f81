"""Chat formatting with loss masks that follow token offsets.

Template: every turn is ``<|endoftext|>### role:<|endoftext|>text``, and the conversation
ends with ``<|endoftext|>``, the tokenizer's one special token. In roles and texts a
backslash becomes two and ``<|`` becomes ``<\\|``, so the marker cannot occur in them, and
dropping the backslash before any character restores them.

A conversation is rendered whole and encoded once, with the offsets of its tokens. The
spans of its assistant texts and the token offsets are both sorted, so each span finds
its tokens by two binary searches. No token crosses a marker; so the masked tokens cover
the assistant texts exactly, and a conversation may be cut before any marker without any
change to its tokens. Only one of more than ``SEGMENT`` characters is: its turns are dealt
to segments by the characters before them, a running sum in two levels (over ranges of
turn numbers, and within them), and segments are rows of their own that are encoded in
different tasks. So a conversation of a third of all rows is never held whole; only the
hashes of its digest are made in order. Rows that repeat a turn number stay together and
are cut by the task that has them.

Turns come in order of ``turn``, then role and text. Defined results: a null text or role
is empty, a null conv_id is a conversation of its own; repeated rows are repeated turns;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm.columns import read
from tallyframe.llm.scratch import stored
from tallyframe.llm.tokens import BYTE_BPE

MARK = "<|endoftext|>"
LOSS_ROLE = "assistant"
SEGMENT = 1 << 22
#: Turn numbers of a long conversation that are summed up in one window.
TURNS = 1024

FORMATTED = "conv_id long, segment long, last boolean, formatted string, ids binary, starts binary, ends binary, mask binary"


def escape(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse(formatted: str, last: bool = True) -> list[tuple[str, str]]:
    """The turns of a whole formatted conversation, or of one of its segments; only the last has the end marker."""
    parts = (formatted.removesuffix(MARK) if last else formatted).split(MARK)[1:]
    heads = [unescape(h.removeprefix("### ").removesuffix(":")) for h in parts[::2]]
    return list(zip(heads, map(unescape, parts[1::2]), strict=True))


@functools.cache
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)  # markers in the rendered text are special tokens


@dataclass
class Segment:
    conv_id: int | None
    number: int = 0
    parts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def add(self, role: str | None, text: str | None) -> None:
        head, body = f"{MARK}### {escape(role)}:{MARK}", escape(text)
        start = self.size + len(head)
        self.size = start + len(body)
        self.parts += [head, body]
        if role == LOSS_ROLE:
            self.spans.append((start, self.size))

    def encoded(self, path: str, last: bool) -> dict:
        formatted = "".join(self.parts) + MARK * last
        code = _tokenizer(path).encode(formatted, add_special_tokens=False)
        offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
        mask = np.zeros(len(offsets), np.uint8)
        spans = np.array(self.spans, np.int64).reshape(-1, 2)
        first = np.searchsorted(offsets[:, 0], spans[:, 0], side="left")
        behind = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
        for a, b in zip(first.tolist(), behind.tolist(), strict=True):
            mask[a:b] = 1
        return {
            "conv_id": self.conv_id,
            "segment": self.number,
            "last": last,
            "formatted": formatted,
            "ids": np.array(code.ids, "<u4").tobytes(),
            "starts": offsets[:, 0].astype("<u4").tobytes(),
            "ends": offsets[:, 1].astype("<u4").tobytes(),
            "mask": mask.tobytes(),
        }


def rendered_size(role: Column, text: Column) -> Column:
    def escaped(c: Column) -> Column:
        return F.length(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|")))

    return (2 * len(MARK) + len("### :") + escaped(role) + escaped(text)).cast("long")


def segment_starts(rows: DataFrame, segment: int) -> dict[int | None, list[int]]:
    """For each conversation of more than ``segment`` characters the first turns of its segments but the first.

    It goes to the driver: one number for each ``segment`` characters.
    """
    size = rendered_size(F.col("role"), F.col("text")).alias("size")
    sums = rows.select("conv_id", "turn", size).groupBy("conv_id", "turn").agg(F.sum("size").alias("size"))
    sums = stored(sums.withColumn("range", F.floor(F.col("turn") / TURNS)), "turns")
    total = F.sum("size").alias("size")
    long = stored(sums.groupBy("conv_id").agg(total).where(F.col("size") > segment).select(F.col("conv_id").alias("c")), "long")
    if long.isEmpty():
        return {}
    sums = sums.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")

    def before(window) -> Column:
        return F.coalesce(F.sum("size").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = sums.groupBy("conv_id", "range").agg(total)
    ranges = ranges.select(
        F.col("conv_id").alias("c"),
        F.col("range").alias("r"),
        before(Window.partitionBy("conv_id").orderBy("range")).alias("range_before"),
    )
    inner = sums.withColumn("inner_before", before(Window.partitionBy("conv_id", "range").orderBy("turn")))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("range").eqNullSafe(F.col("r"))
    at = F.floor((F.col("inner_before") + F.col("range_before")) / segment).alias("at")
    first = inner.join(ranges, same).groupBy("conv_id", at).agg(F.min("turn").alias("turn"))
    out = defaultdict(list)
    for r in first.where("at > 0").collect():
        out[r["conv_id"]].append(r["turn"])
    return {c: sorted(turns) for c, turns in out.items()}


def group_of(starts: dict[int | None, list[int]]) -> Column:
    """Which of the consecutive groups of its conversation a turn is in; a null turn comes first."""

    def find(conv, no_conv, turn, no_turn):
        found = [starts.get(None if n else c, ()) for c, n in zip(conv, no_conv, strict=True)]
        return pd.Series([0 if n else bisect_right(s, t) for s, t, n in zip(found, turn, no_turn, strict=True)], dtype="int64")

    conv, turn = F.col("conv_id"), F.col("turn")
    filled = [F.coalesce(conv, F.lit(0)), conv.isNull(), F.coalesce(turn, F.lit(0)), turn.isNull()]
    return F.pandas_udf(find, "long")(*filled) if starts else F.lit(0).cast("long")


def format_chats(turns: DataFrame, tokenizer: str = BYTE_BPE, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation (several for one longer than ``segment``; ``segment`` orders them): text, ids, offsets, mask."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    starts = segment_starts(rows, segment)
    last_group = {c: len(s) for c, s in starts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Segment | None = None
        at = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "at", "role", "text")]
            for conv_id, group, role, text in zip(*columns, strict=True):
                if now is not None and (conv_id, group) != at:
                    yield _batch(now.encoded(tokenizer, last=at[1] == last_group.get(at[0], 0)))
                    now = None
                elif now is not None and now.size >= segment:
                    yield _batch(now.encoded(tokenizer, last=False))
                    now = Segment(conv_id, now.number + 1)
                at = conv_id, group
                now = now or Segment(conv_id, group << 32)
                now.add(role, text)
        if now is not None:
            yield _batch(now.encoded(tokenizer, last=at[1] == last_group.get(at[0], 0)))

    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.withColumn("at", group_of(starts)).repartition(parts, "conv_id", "at")
    return ordered.sortWithinPartitions("conv_id", "at", "turn", "role", "text").mapInArrow(run, FORMATTED)


def _batch(row: dict) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text that the masked tokens cover, each character once, unescaped."""
    at = np.flatnonzero(mask)
    if not len(at):
        return ""
    a, b = starts[at].astype(np.int64), ends[at].astype(np.int64)
    # Tokens of one character's bytes have the same offsets; runs of touching tokens are one slice.
    first = np.flatnonzero(np.append(True, a[1:] > np.maximum.accumulate(b)[:-1]))
    last = np.append(first[1:], len(at)) - 1
    reach = np.maximum.accumulate(b)
    return unescape("".join(formatted[x:y] for x, y in zip(a[first].tolist(), reach[last].tolist(), strict=True)))


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


#: What a segment says: of a whole conversation the hashes, else the texts to be hashed.
READ_BACK = "conv_id long, segment long, whole boolean, n long, turns binary, loss_chars long, loss binary, chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it; the hashes of a conversation in segments are made in their order."""

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                said = parse(row["formatted"], row["last"])
                turns = "".join(f"{role}\n{text}\n" for role, text in said).encode()
                columns = [np.frombuffer(row[c], k) for c, k in (("starts", "<u4"), ("ends", "<u4"), ("mask", np.uint8))]
                loss = masked_text(row["formatted"], *columns)
                whole = row["segment"] == 0 and row["last"]
                n, spoken = len(loss), loss.encode()
                if whole:
                    turns, spoken = hashlib.sha256(turns).digest(), hashlib.sha256(spoken).digest()
                yield _named(
                    READ_BACK, [row["conv_id"], row["segment"], whole, len(said), turns, n, spoken, len(row["formatted"])]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["segment"] == 0:
                    if now:
                        yield _digest(now)
                    now = None
                if row["whole"]:
                    values = row["turns"].hex(), row["loss_chars"], row["loss"].hex(), row["chars"]
                    yield _named(DIGEST, [row["conv_id"], row["n"], *values])
                    continue
                now = now or {"conv": row["conv_id"], "n": 0, "t": hashlib.sha256(), "c": 0, "l": hashlib.sha256(), "f": 0}
                now["n"] += row["n"]
                now["t"].update(row["turns"])
                now["c"] += row["loss_chars"]
                now["l"].update(row["loss"])
                now["f"] += row["chars"]
        if now:
            yield _digest(now)

    parts = max(1, int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    said = formatted.mapInArrow(say, READ_BACK).repartition(parts, "conv_id")
    return said.sortWithinPartitions("conv_id", "segment").mapInArrow(run, DIGEST)


def _digest(x: dict) -> pa.RecordBatch:
    return _named(DIGEST, [x["conv"], x["n"], x["t"].hexdigest(), x["c"], x["l"].hexdigest(), x["f"]])


def _named(ddl: str, values: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*[c.split() for c in ddl.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[t]) for v, t in zip(values, types, strict=True)], names=list(names))


def with_control_case(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose two texts hold strings of chat templates."""
    turns = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    case = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return turns.unionByName(case)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(format_chats(with_control_case(read(spark, sf_dir, "conversations"))))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL
  SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), per_conversation AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(2 * 13 + 5 + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
             + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) + 13 AS chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM per_conversation
"""
