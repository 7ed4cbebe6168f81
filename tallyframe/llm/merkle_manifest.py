"""A Merkle manifest of a dataset, with versions of tampered leaves by path copying.

Every row is a leaf: the SHA-256 of its columns. The leaves of one language form a tree in
doc_id order, and the roots of these trees form one more tree, whose root stands for the
whole table. Two consecutive nodes become one of the next level (a last one alone too)
while a tree has more than one node.

Trees are cut into aligned blocks of 2**BITS leaves. A block's tree is built in one task;
the roots of the blocks are the leaves of the next level of blocks, and so on, so that
each round has 2**BITS times fewer nodes and no task holds more than a block. Nodes are
never changed: a tampered leaf makes a version of its block's tree that copies the leaf's
ancestors and shares every other node. Above the block the version goes on in the same
task with the siblings on its way, which the upper blocks hand down (one row for each
block); so versions are spread like the leaves, not gathered at the upper nodes.

Ranks come from one range exchange over (language, doc_id, leaf): a language of a third of
all rows is many ranges, and the place of a range in its tree is a running sum over ranges.

Defined results: a null column is ``-`` in a leaf, and a null or very long text is a leaf
like any other; a null language is a tree of its own and comes first; null ids come first
in their tree and are never tampered with; rows that repeat an id are leaves in the order
of their hashes, and rows equal in every column stand side by side; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.columns import read
from tallyframe.llm.scratch import stored

#: Levels of a block's tree: a block holds 2**BITS leaves.
BITS = 10
TAMPER_EVERY = 7

# Trees in one task. A node is (hash, left, right); a leaf has no children, and neither is ever changed.

Node = tuple[str, "Node | None", "Node | None"]


def joined(*hashes: str) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def parent(left: Node, right: Node | None) -> Node:
    return (joined(left[0], right[0]) if right else joined(left[0]), left, right)


def levels_of(n: int) -> int:
    """Levels above the leaves of a whole tree of n leaves."""
    return (n - 1).bit_length()


def build(hashes: list[str], height: int) -> Node:
    nodes: list[Node] = [(h, None, None) for h in hashes]
    for _ in range(height):
        nodes = [parent(nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None) for i in range(0, len(nodes), 2)]
    return nodes[0]


def replaced(node: Node, height: int, i: int, leaf: str) -> Node:
    """The version of a tree with another leaf: ancestors are copied, all else is shared."""
    if not height:
        return (leaf, None, None)
    _, left, right = node
    half = 1 << (height - 1)
    if i < half:
        return parent(replaced(left, height - 1, i, leaf), right)
    return parent(left, replaced(right, height - 1, i - half, leaf))


def siblings_of(root: Node, height: int, i: int) -> tuple[list[str], str]:
    """From leaf i upwards the siblings' hashes, and for each level L, R or - (left, right, none)."""
    hashes, sides = [], []
    for level in range(height - 1, -1, -1):
        _, left, right = root
        if i >> level & 1:
            hashes.append(left[0])
            sides.append("L")
            root = right
        else:
            if right:
                hashes.append(right[0])
            sides.append("R" if right else "-")
            root = left
    return hashes[::-1], "".join(sides[::-1])


def fold(node: str, hashes: list[str], sides: str) -> str:
    """The root over ``node``, from the siblings on the way."""
    left = iter(hashes)
    for side in sides:
        node = joined(node) if side == "-" else joined(next(left), node) if side == "L" else joined(node, next(left))
    return node


# Trees over many tasks

NODES = "tree string, rank long, n long, node string"
ABOVE = "tree string, rank long, siblings array<string>, sides string, top string"


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their rank in the order of their tree, and the tree's size n."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    keys = ["tree", *order, "tie"]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    # The number of a row has its partition in the upper bits and its place there in the lower 33.
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    sums = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    tree = Window.partitionBy("tree")  # one row for each range of the tree
    before = F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(
        "tree", "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(tree).alias("n")
    )
    out = placed.join(sums, ["tree", "part"]).withColumn("rank", F.expr("place - first + before"))
    return out.drop("part", "place", "first", "before")


def in_blocks(nodes: DataFrame, bits: int, *carried: str) -> DataFrame:
    """One row for each aligned block: tree, block, n and its items in order."""
    item = F.struct("rank", "node", *carried)
    return (
        nodes.withColumn("block", F.shiftright("rank", bits))
        .groupBy("tree", "block", "n")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))  # 2**bits at most
    )


def _height(n: int, bits: int) -> int:
    """Levels that a block of a tree of n leaves covers."""
    return min(bits, levels_of(n))


def block_roots(blocks: DataFrame, bits: int) -> DataFrame:
    """The roots of blocks as the nodes (NODES) of the level above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"tree": [], "rank": [], "n": [], "node": []}
            for row in batch.to_pylist():
                root = build([x["node"] for x in row["items"]], _height(row["n"], bits))
                values = row["tree"], row["block"], -(-row["n"] // (1 << bits)), root[0]
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema(_fields(NODES)))

    return blocks.select("tree", "block", "n", "items").mapInArrow(run, NODES)


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return [(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))]


def climbed(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """For each node (NODES) the way up (ABOVE): siblings and sides up to the root of its tree, and that root."""
    if nodes.where("n > 1").isEmpty():
        none = F.array().cast("array<string>").alias("siblings")
        return nodes.select("tree", "rank", none, F.lit("").alias("sides"), F.col("node").alias("top"))
    blocks = stored(in_blocks(nodes, bits), "blocks")
    above = climbed(stored(block_roots(blocks, bits), "roots"), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                height = _height(row["n"], bits)
                root = build([x["node"] for x in row["items"]], height)
                out: dict[str, list] = {"tree": [], "rank": [], "siblings": [], "sides": [], "top": []}
                for i, x in enumerate(row["items"]):
                    hashes, sides = siblings_of(root, height, i)
                    values = row["tree"], x["rank"], hashes + row["siblings"], sides + row["sides"], row["top"]
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_pydict(out, pa.schema(_fields(ABOVE)))

    return stored(_under(blocks, above).mapInArrow(run, ABOVE), "above")


def _under(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``blocks`` with the way up from their roots."""
    return blocks.join(above.withColumnRenamed("rank", "block"), ["tree", "block"])


PROOFS = (
    "tree string, rank long, doc_id long, leaf string, changed string, subroot string, root string, "
    "siblings array<string>, sides string, changed_root string, copied long"
)


def proofs(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """For each leaf of (tree, doc_id, node, changed) its tree's root, the whole root and its proof.

    ``changed`` is the leaf after tampering, or null; ``changed_root`` is then the root of the
    version in which only this leaf differs, for which ``copied`` nodes were made, and is
    folded from ``node`` otherwise.
    """
    blocks = stored(in_blocks(ranked(leaves, "doc_id", "node"), bits, "doc_id", "changed"), "blocks")
    above = climbed(stored(block_roots(blocks, bits), "roots"), bits)
    subroots = above.where("rank = 0").select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("top").alias("node"))
    subroots = stored(ranked(subroots, "own"), "subroots")
    tops = climbed(subroots.select("tree", "rank", "n", "node"), bits).join(subroots.select("own", "rank"), "rank")
    tops = tops.select(
        F.col("own").alias("tree"),
        F.col("siblings").alias("last"),
        F.col("sides").alias("last_sides"),
        F.col("top").alias("root"),
    )
    above = above.join(tops, "tree").select(
        "tree",
        "rank",
        F.concat("siblings", "last").alias("siblings"),
        F.concat("sides", "last_sides").alias("sides"),
        F.col("top").alias("subroot"),
        "root",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PROOFS.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                height = _height(row["n"], bits)
                root = build([x["node"] for x in row["items"]], height)
                upper = row["siblings"], row["sides"]
                out: dict[str, list] = {name: [] for name in names}
                for i, x in enumerate(row["items"]):
                    hashes, sides = siblings_of(root, height, i)
                    hashes, sides = hashes + upper[0], sides + upper[1]
                    if x["changed"] is None:
                        version, copied = fold(x["node"], hashes, sides), 0
                    else:
                        version = fold(replaced(root, height, i, x["changed"])[0], *upper)
                        copied = 1 + len(sides)
                    values = (
                        row["tree"], x["rank"], x["doc_id"], x["node"], x["changed"], row["subroot"], row["root"],
                        hashes, sides, version, copied,
                    )
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_pydict(out, pa.schema(_fields(PROOFS)))

    return _under(blocks, above).mapInArrow(run, PROOFS)


# The documents


def leaf_of(*values: Column) -> Column:
    """The leaf of a row: the hash of its values, each with its length in front, or ``-`` for null."""
    said = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*said), 256)


def document_leaves(docs: DataFrame, every: int = TAMPER_EVERY) -> DataFrame:
    """(tree, doc_id, node, changed) of documents; one in ``every`` has its n_chars raised by one."""
    number, text = F.col("n_chars").cast("decimal(20,0)"), F.col("text").cast("string")
    key = F.col("doc_id").cast("long")
    front = [key.cast("string"), F.col("source").cast("string"), F.col("lang").cast("string")]
    chosen = F.crc32(key.cast("string").cast("binary")) % every == 0
    return docs.select(
        # A null language sorts before all others, which keep their bytewise order.
        F.coalesce(F.concat(F.lit("="), front[2]), F.lit("-")).alias("tree"),
        key.alias("doc_id"),
        leaf_of(*front, number.cast("string"), text).alias("node"),
        F.when(chosen, leaf_of(*front, (number + 1).cast("decimal(20,0)").cast("string"), text)).alias("changed"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(document_leaves(read(spark, sf_dir, "documents"))).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(F.concat_ws("", "siblings"), 256).alias("proof_sha256"),
        F.col("changed_root").alias("folded_root"),
        (F.col("changed_root") == F.col("root")).alias("verified"),
    )


#: crc32 of decimal numbers, as a table of bytes and a fold over digits.
CRC32_SQL = """crc_table AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384)) AS c
    FROM (SELECT range AS b FROM range(256))
  )
)"""


def crc32_sql(number: str) -> str:
    """SQL for the unsigned crc32 of a number's decimal digits; needs ``crcs`` of CRC32_SQL in scope."""
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    step = "lambda c, d: xor(c >> 8, crcs[xor(c, d) % 256 + 1])"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {digits}, {step}), 4294967295)"


OP13_SQL = f"""
WITH RECURSIVE {CRC32_SQL}, said AS (
  SELECT doc_id, lang, coalesce('=' || lang, '-') AS tree, {crc32_sql("doc_id")} % {TAMPER_EVERY} = 0 AS tampered,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
           || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS back
  FROM documents, crc_table
), leaves AS (
  SELECT doc_id, tree,
         sha256(front || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || back) AS leaf,
         CASE WHEN tampered
              THEN sha256(front || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || back)
         END AS changed
  FROM said
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
         count(*) OVER (PARTITION BY tree) AS n
  FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, rank AS idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n
), subroots AS (
  SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, rank AS idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM upper WHERE n > 1 GROUP BY level, idx // 2, n
), root AS (
  SELECT h AS root, level AS top FROM upper WHERE n = 1
), ways AS (
  SELECT 'tree' || tree AS tree, level, idx, h FROM nodes
  UNION ALL SELECT 'upper', level, idx, h FROM upper
), walk AS (
  SELECT row_number() OVER () AS id, doc_id, leaf, subroot, root, 'tree' || tree AS tree, 0 AS level, p.rank AS idx,
         height, s.rank AS upper_idx, top, '' AS proof, coalesce(changed, leaf) AS h
  FROM placed p JOIN subroots s USING (tree) CROSS JOIN root
  UNION ALL
  SELECT id, doc_id, leaf, subroot, root, t, l + 1, i // 2, hh, upper_idx, top, proof || coalesce(w.h, ''),
         sha256(CASE WHEN i % 2 = 1 THEN w.h || x.h ELSE x.h || coalesce(w.h, '') END)
  FROM (
    SELECT *, CASE WHEN tree <> 'upper' AND level = height THEN 'upper' ELSE tree END AS t,
           CASE WHEN tree <> 'upper' AND level = height THEN 0 ELSE level END AS l,
           CASE WHEN tree <> 'upper' AND level = height THEN upper_idx ELSE idx END AS i,
           CASE WHEN tree <> 'upper' AND level = height THEN top ELSE height END AS hh
    FROM walk
  ) x LEFT JOIN ways w ON w.tree = t AND w.level = l AND w.idx = xor(i, 1)
  WHERE l < hh
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM walk WHERE (tree = 'upper' AND level = top) OR (top = 0 AND tree <> 'upper' AND level = height)
"""
