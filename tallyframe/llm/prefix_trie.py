"""The prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns (role and text); conversations that start with
it are its members. Conversations are dealt in ranges of conv_id, and a task takes its range
in shards of at most ``shard`` turns. A shard is an index from (position, turn) to the
bitset of its conversations. From the root on, depth first, the children of a node are the
intersections of its bitset with the postings of the next position: the lowest conversation
not yet dealt names a posting, and what the intersection holds is dealt. A child's popcount
is its number of members, its lowest bit their smallest conv_id, and the intersection with
the bitset of conversations that end there gives the end list.

A conversation longer than a shard goes on in the next one: it then starts at its node
instead of the root, so memory is bounded by ``shard`` whatever the length.

Nodes are named by a 128-bit chain of digests of their turns, so shards add up by name, on
the map side first (the root is one row for each task). Sums over subtrees need no climb:
every node counts for its smallest member, and a member carries the sum of its nodes
to each node it passes; what the smallest member of a node owns above it is subtracted.
End lists are joined in order of conv_id by a streaming digest.

Defined results: turns are ordered by number (null first), then role and text; a null role
or text is empty; rows that repeat a turn are turns of their own; rows without conv_id
belong to no conversation and are left out; a conversation without turns once rebuilt ends
at the root; an empty table has no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.columns import read
from tallyframe.llm.merkle_manifest import CRC32_SQL, crc32_sql
from tallyframe.llm.scratch import stored

#: Turns of a shard at most.
SHARD = 1 << 14
#: Conversations that share a first part in the rebuilt table, and its turns at most.
FAMILY, SHARED = 20, 4

ROOT = bytes(16)


def chained(key: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(key + turn, digest_size=16).digest()


# One shard


@dataclass
class Part:
    """A conversation, or the part of one that is in a shard, from the node it starts at."""

    conv_id: int
    depth: int = 0
    key: bytes = ROOT
    turns: list[bytes] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    ended: bool = True


@dataclass
class Found:
    """What one shard adds to a node."""

    key: bytes
    parent: bytes | None
    depth: int | None
    members: int
    conv_id: int | None
    words: int
    ends: list[int]


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


class Shard:
    """Vertical bitmaps over parts of conversations in ascending order of conv_id."""

    def __init__(self, parts: list[Part]):
        self.parts = parts
        self.postings: dict[tuple[int, bytes], int] = {}
        self.starts: dict[tuple[int, bytes], int] = {}
        self.ends: dict[int, int] = {}
        self.stops: dict[int, int] = {}
        for i, part in enumerate(parts):
            bit = 1 << i
            start = (part.depth, part.key)
            self.starts[start] = self.starts.get(start, 0) | bit
            for position, turn in enumerate(part.turns, part.depth + 1):
                self.postings[position, turn] = self.postings.get((position, turn), 0) | bit
            last = part.depth + len(part.turns)
            self.stops[last] = self.stops.get(last, 0) | bit
            if part.ended:
                self.ends[last] = self.ends.get(last, 0) | bit

    def found(self, keys: list[list[bytes]]) -> Iterator[Found]:
        """What the shard adds to each node; ``keys`` gets the nodes below its start of every part."""
        for (depth, key), bitset in self.starts.items():
            # The members of a node at which parts go on were counted where it was reached.
            members = bitset.bit_count() if depth == 0 else 0
            lowest = self.parts[(bitset & -bitset).bit_length() - 1].conv_id if members else None
            todo = [(Found(key, None, depth, members, lowest, 0, []), bitset)]
            while todo:
                node, bitset = todo.pop()
                ended = bitset & self.ends.get(node.depth, 0)
                node.ends = [self.parts[i].conv_id for i in _bits(ended)]
                yield node
                rest = bitset & ~self.stops.get(node.depth, 0)
                below = node.depth + 1
                while rest:
                    i = (rest & -rest).bit_length() - 1
                    part = self.parts[i]
                    at = node.depth - part.depth
                    turn = part.turns[at]
                    child = rest & self.postings[below, turn]
                    rest ^= child
                    name = chained(node.key, turn)
                    for j in _bits(child):
                        keys[j].append(name)
                    todo.append(
                        (Found(name, node.key, below, child.bit_count(), part.conv_id, part.words[at], []), child)
                    )


# The rebuilt conversations


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, words): the turns in order, as digests."""
    filled = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("number"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("number"), "role", "text")
    return filled.select(
        "conv_id",
        F.row_number().over(order).alias("pos"),
        F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("turn"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )


ROWS = ("conv_id", "part", "pos", "turn", "words")


def as_they_are(turns: DataFrame) -> DataFrame:
    """Rows of conversations for ``trie``: one that opens each, and one for each turn."""
    open_ = turns.select("conv_id").distinct()
    return _with_openings(open_, turns.select("conv_id", F.lit(1).alias("part"), "pos", "turn", "words"))


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """The same, where each conversation starts with the first turns of the first one of its family."""
    turns = stored(turns, "turns")
    borrowed = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    convs = turns.select("conv_id").distinct().withColumn("h", borrowed)
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < shared))
    heads = heads.withColumnRenamed("conv_id", "base")
    first = convs.withColumn("base", F.expr(f"conv_id - conv_id % {family}")).join(heads, "base").where("pos <= h")
    first = first.select("conv_id", F.lit(0).alias("part"), "pos", "turn", "words")
    own = turns.where(F.col("pos") > borrowed).select("conv_id", F.lit(1).alias("part"), "pos", "turn", "words")
    return _with_openings(convs.select("conv_id"), first.unionByName(own))


def _with_openings(convs: DataFrame, rows: DataFrame) -> DataFrame:
    nothing = F.lit(None)
    open_ = convs.select(
        "conv_id", F.lit(-1).alias("part"), F.lit(0).alias("pos"), nothing.cast("binary").alias("turn"), F.lit(0).alias("words")
    )
    return open_.unionByName(rows.select(*ROWS))


# Shards of a table

FOUND = (
    "hi long, lo long, parent_hi long, parent_lo long, depth long, members long, n_ends long, conv_id long, "
    "words long, ends binary, first_end long, his array<long>, los array<long>"
)
KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
FOUND_SCHEMA = pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in FOUND.split(", "))])


def _two(key: bytes | None) -> list[int | None]:
    return [None, None] if key is None else np.frombuffer(key, "<i8").tolist()


def _shard_batch(parts: list[Part]) -> pa.RecordBatch:
    """A row for each node of a shard, and (without members) one for the way of each part."""
    keys: list[list[bytes]] = [[part.key] if part.depth == 0 else [] for part in parts]
    rows = []
    for x in Shard(parts).found(keys):
        ends = np.array(x.ends, "<i8").tobytes(), (x.ends or [None])[0]
        rows.append((*_two(x.key), *_two(x.parent), x.depth, x.members, len(x.ends), x.conv_id, x.words, *ends, None, None))
    for part, way in zip(parts, keys, strict=True):
        pairs = np.frombuffer(b"".join(way), "<i8").reshape(-1, 2)
        rows.append((*[None] * 5, 0, 0, part.conv_id, 0, None, None, pairs[:, 0].tolist(), pairs[:, 1].tolist()))
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, FOUND_SCHEMA, strict=True)], schema=FOUND_SCHEMA
    )


def shards(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """What every shard finds (FOUND), from rows of conversations (ROWS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Part] = []
        held = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "words")]
            for conv_id, turn, words in zip(*columns, strict=True):
                if turn is None:  # the row that opens a conversation
                    if held >= shard:
                        yield _shard_batch(parts)
                        parts, held = [], 0
                    parts.append(Part(conv_id))
                    held += 1
                    continue
                part = parts[-1]
                if held >= shard:  # within a conversation: the rest of it starts at the node reached
                    if not part.turns and part.depth == 0:
                        parts.pop()  # it has only been opened, and is a member of the root once
                    part.ended = False
                    key = part.key
                    for x in part.turns:
                        key = chained(key, x)
                    if parts:
                        yield _shard_batch(parts)
                    part = Part(conv_id, part.depth + len(part.turns), key)
                    parts, held = [part], 0
                part.turns.append(turn)
                part.words.append(words)
                held += 1
        if parts:
            yield _shard_batch(parts)

    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(rows, "turns").repartitionByRange(tasks, "conv_id")
    return dealt.sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "turn", "words").mapInArrow(run, FOUND)


# The trie

NODE = ["hi", "lo"]


def end_digests(found: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of nodes at which conversations end, as a stream in order of conv_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out: list[tuple] = []
            names = zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist(), strict=True)
            for name, ends in zip(names, batch.column("ends"), strict=True):
                said = ",".join(map(str, np.frombuffer(ends.as_py(), "<i8").tolist())).encode()
                if name == now:
                    sha.update(b"," + said)
                    continue
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = name, hashlib.sha256(said)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, sha.hexdigest())], schema=schema)

    tasks = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Shards are ranges of conv_id, so their lists follow one another.
    lists = found.where("n_ends > 0").select(*NODE, "first_end", "ends")
    ordered = lists.repartition(tasks, *NODE).sortWithinPartitions(*NODE, "first_end")
    return ordered.mapInArrow(run, "hi long, lo long, ends_sha256 string")


def trie(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of conversations, from their rows (ROWS)."""
    found = stored(shards(rows, shard), "shards")
    nodes = stored(
        found.where("hi is not null")
        .groupBy(*NODE)
        .agg(
            F.max("parent_hi").alias("parent_hi"),
            F.max("parent_lo").alias("parent_lo"),
            F.max("depth").alias("depth"),
            F.sum("members").alias("n_convs"),
            F.sum("n_ends").alias("n_ends"),
            F.min("conv_id").alias("conv_id"),
            F.max("words").alias("words"),
        )
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("words")),
        "nodes",
    )
    # A node counts for its smallest member; those of one member follow one another down a single way.
    above = F.sum("saved").over(
        Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("long")
    own = nodes.select(
        *NODE, "parent_hi", "parent_lo", "depth", "n_convs", "conv_id",
        zero.alias("n_children"), zero.alias("n_leaves"), (-F.coalesce(above, zero)).alias("saved_tokens"),
    )
    none = [F.lit(None).cast("long").alias(c) for c in ("parent_hi", "parent_lo", "depth", "n_convs", "conv_id")]
    children = nodes.where("depth > 0").select(
        F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo"), *none,
        F.lit(1).cast("long").alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"),
    )
    carried = nodes.groupBy("conv_id").agg(
        F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ways = found.where("hi is null").select("conv_id", F.arrays_zip("his", "los").alias("way"))
    passed = ways.join(carried.where("n_leaves > 0 or saved_tokens > 0"), "conv_id")
    passed = passed.select(F.explode("way").alias("x"), "n_leaves", "saved_tokens").select(
        F.col("x.his").alias("hi"), F.col("x.los").alias("lo"), *none, zero.alias("n_children"), "n_leaves", "saved_tokens"
    )
    summed = own.unionByName(children).unionByName(passed).groupBy(*NODE)
    total = summed.agg(
        *[F.max(c).alias(c) for c in ("parent_hi", "parent_lo", "depth", "n_convs", "conv_id")],
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")],
    )
    total = total.join(end_digests(found), NODE, "left")
    # The children of the root, which may be most nodes, need no join to find their parent's id.
    first = nodes.where("depth = 0").select("conv_id").first()
    root = F.lit(first["conv_id"] if first else None).cast("long")
    parents = nodes.where("depth > 0").select(
        F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("found")
    )
    deep = total.where("depth > 1").join(parents, ["parent_hi", "parent_lo"], "left")
    flat = total.where("depth <= 1").withColumn("found", F.when(F.col("depth") == 1, root))
    nothing = hashlib.sha256(b"").hexdigest()
    return deep.unionByName(flat).select(
        "conv_id", "depth", F.col("found").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns_of(read(spark, sf_dir, "conversations"))))


OP12_SQL = f"""
WITH {CRC32_SQL}, turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("conv_id")} % {SHARED} AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), parts AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = base WHERE pos <= h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE pos > h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth,
         md5(strlen(role) || ':' || role || text) AS turn,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM parts
), members AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS words FROM convs
  UNION ALL
  SELECT conv_id, depth, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth), words FROM placed
), lasts AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM members
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         count(*) = count(*) FILTER (ended) AS childless,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM lasts GROUP BY path, depth
), subtrees AS (
  SELECT v.path, count(*) FILTER (x.childless) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens,
         count(*) FILTER (x.depth = v.depth + 1) AS n_children
  FROM nodes v JOIN nodes x ON starts_with(x.path, v.path) GROUP BY v.path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees USING (path)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND starts_with(n.path, p.path)
"""
