"""Near duplicates among embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learnt on a bounded sample (``sample`` vectors, the first in hash order): the
centred vectors are projected on their principal directions and turned, in alternation with
their signs, so that the signs quantise them with the least error. The signs are the code of
a vector. Codes are cut into substrings; each substring position is a table, and vectors
with an equal substring are candidates. Several rotations, from different starts, give more
tables than one code has room for.

The length of a substring grows with the logarithm of the number of vectors, so that a
bucket of unrelated vectors stays small, and the number of tables follows from the recall
wanted: the fit measures how often a substring of two vectors at exactly the threshold is
equal, and takes as many tables as miss such a pair with probability 1 - ``recall``. All
rows are indexed, whatever the sample.

1. Equal vectors are one class; only classes go on.
2. Every class enters every table. Buckets of one class end here.
3. In a small bucket, codes are compared: a class with no other within ``reach`` bits
   leaves the bucket. A large one goes on whole.
4. The vectors of what is left meet in blocks of bounded size; the pairs of blocks of a
   large bucket are different tasks. A block of cosines is a matrix product in double
   precision; it returns for each class its number of links and at most one edge, never
   pairs. A pair counts in the first table in which its substrings are equal.

Edges are closed into components by large star and small star rounds.

Defined results: a vector that is null, empty, zero or holds a null, NaN or infinity links
with nothing and is its own component; equal vectors link with each other; vectors of
different lengths are compared as if the shorter one ended in zeros; rows that repeat a
vec_id are vectors of their own and share the id in the component; a component of null ids
only has a null component_id; an empty table gives no rows; labels and extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.columns import read
from tallyframe.llm.partenum_join import components
from tallyframe.llm.scratch import stored

COSINE = 0.95
SAMPLE = 8000
RECALL = 0.97
ROUNDS = 30
#: Bits of a code at most, and of a substring at least.
CODE_BITS, LEAST_BITS = 64, 8
#: Classes of a bucket up to which codes are compared first, and classes of a block. Results do not depend on them.
SMALL = 2048
BLOCK = 1024


# The quantiser


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, also where squares would overflow."""
    x = np.asarray(vectors, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Quantiser:
    """Rotations and how their codes are cut into tables."""

    mean: np.ndarray
    turns: list[np.ndarray]
    bits: int  # of a substring
    tables: int
    reach: int  # bits in which codes at the threshold practically never differ more

    @property
    def per_code(self) -> int:
        return max(1, self.turns[0].shape[1] // self.bits)

    def signs(self, x: np.ndarray) -> list[np.ndarray]:
        return [(x - self.mean) @ turn > 0 for turn in self.turns]

    def keys(self, signs: list[np.ndarray]) -> np.ndarray:
        """One column for each table: the substring as a number."""
        out = []
        for table in range(self.tables):
            code, place = divmod(table, self.per_code)
            part = signs[code][:, place * self.bits : (place + 1) * self.bits]
            out.append(part @ (1 << np.arange(part.shape[1], dtype=np.int64)))
        return np.stack(out, 1)


def _rotation(projected: np.ndarray, bits: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """The orthogonal turn that brings the rows closest to their signs, from a random start."""
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return turn


def fit(
    sample: np.ndarray, n: int, cosine: float = COSINE, recall: float = RECALL, rounds: int = ROUNDS
) -> Quantiser:
    """A quantiser for ``n`` vectors, learnt from the unit vectors of ``sample``."""
    rng = np.random.default_rng(11)
    dims = sample.shape[1]
    mean = sample.mean(0)
    _, _, directions = np.linalg.svd(sample - mean, full_matrices=len(sample) < dims)
    main = directions[: min(dims, CODE_BITS)].T
    width = main.shape[1]
    bits = min(width, max(LEAST_BITS, math.ceil(math.log2(max(2, n)))))
    projected = (sample - mean) @ main
    # Partners at exactly the threshold, in random directions.
    aside = rng.standard_normal(sample.shape)
    aside -= (aside * sample).sum(1, keepdims=True) * sample
    length = np.sqrt((aside * aside).sum(1, keepdims=True))
    partner = cosine * sample + math.sqrt(1 - cosine * cosine) * aside / np.where(length > 0, length, 1)
    turns, missed, tables, apart = [], np.ones(len(sample)), 0, 0
    # At least one code; then as many tables as leave few partners without an equal substring.
    while missed.mean() > 1 - recall:
        turns.append(main @ _rotation(projected, width, rng, rounds))
        one = Quantiser(mean, turns[-1:], bits, max(1, width // bits), 0)
        own, other = one.signs(sample), one.signs(partner)
        apart = max(apart, int((own[0] != other[0]).sum(1).max()))
        equal = one.keys(own) == one.keys(other)
        for table in range(equal.shape[1]):
            if missed.mean() > 1 - recall:
                missed = missed * ~equal[:, table]
                tables += 1
        if len(turns) == 64:  # 64 codes are far more than any spread of the data asks for
            break
    return Quantiser(mean, turns, bits, tables, apart + 2)


# Classes


def _usable(vector: str) -> str:
    """SQL: the vector has a component that is not zero, and only finite ones."""
    return (
        f"coalesce(size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        f" and exists({vector}, x -> x <> 0), false)"
    )


def classes_of(rows: DataFrame) -> DataFrame:
    """(a, b, copies, vector) of distinct usable vectors; a and b are hashes that name them."""
    return rows.where("a is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))


def _hashed(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, a, b); a and b are null for vectors that link with nothing."""
    # Adding zero turns -0.0 into 0.0, which is equal to it; zeros at the end say nothing.
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    clean = F.expr(f"transform(cast(embedding as array<{kind}>), x -> x + cast(0 as {kind}))")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), clean.alias("vector"))
    last = "array_max(transform(sequence(1, size(vector)), i -> if(vector[i - 1] <> 0, i, 0)))"
    usable = F.expr(_usable("vector"))
    rows = rows.withColumn("vector", F.when(usable, F.expr(f"slice(vector, 1, {last})")))
    return rows.withColumns(
        {
            "a": F.when(F.col("vector").isNotNull(), F.xxhash64("vector")),
            "b": F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector")),
        }
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column, with zeros behind shorter ones, as unit rows."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return unit(flat.reshape(-1, dims))
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), _places(lengths)] = flat
    return unit(out)


def _places(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


# Tables


def _coded(classes: DataFrame, quantiser: Quantiser, dims: int) -> DataFrame:
    """(cid, keys, codes): the substring of each class in each table, and its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            signs = quantiser.signs(_matrix(batch.column("vector"), dims))
            codes = np.zeros((len(batch), len(signs), 8), np.uint8)
            for i, sign in enumerate(signs):
                packed = np.packbits(sign, axis=1)
                codes[:, i, : packed.shape[1]] = packed
            columns = [quantiser.keys(signs).tolist(), codes.view("<i8")[:, :, 0].tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), *(pa.array(c, pa.list_(pa.int64())) for c in columns)], names=["cid", "keys", "codes"]
            )

    return classes.select("cid", "vector").mapInArrow(run, "cid long, keys array<long>, codes array<long>")


def _entries(coded: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(cid, table, key, code): each class once in each table."""
    code = F.col("codes")[F.floor(F.col("table") / quantiser.per_code).cast("int")]
    out = coded.select("cid", "codes", F.posexplode("keys").alias("table", "key"))
    return out.select("cid", "table", "key", code.alias("code"))


def _with_company(small: DataFrame, reach: int, tasks: int) -> DataFrame:
    """(cid, table, key) of classes with another one of their bucket within ``reach`` bits."""

    def near(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), bool)
        for start in range(0, len(codes), 256):
            apart = np.bitwise_count(codes[start : start + 256, None] ^ codes[None, :])
            out[start : start + 256] = (apart <= reach).sum(1) > 1  # itself is one
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the bucket that the last batch ended in
        names = ["cid", "table", "key"]

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((rows[1:, 1] != rows[:-1, 1]) | (rows[1:, 2] != rows[:-1, 2])) + 1
            keep = np.concatenate([near(part) for part in np.split(rows[:, 3].view(np.uint64), change)])
            kept = rows[keep]
            columns = [pa.array(kept[:, 0]), pa.array(kept[:, 1].astype(np.int32)), pa.array(kept[:, 2])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*names, "code")], 1)
            held.append(rows)
            rows = np.concatenate(held)
            last = (rows[:, 1] == rows[-1, 1]) & (rows[:, 2] == rows[-1, 2])
            if not last.all():
                yield flush(np.ascontiguousarray(rows[~last]))
            held = [rows[last]]
        if held:
            yield flush(np.ascontiguousarray(np.concatenate(held)))

    dealt = small.select("cid", "table", "key", "code").repartition(tasks, "table", "key")
    return dealt.sortWithinPartitions("table", "key").mapInArrow(run, "cid long, table int, key long")


# Cosines


LINKS = "cid long, links long, other long"


def _block_links(
    vectors: np.ndarray, cids: np.ndarray, copies: np.ndarray, keys: np.ndarray, sides: np.ndarray, table: int, cosine: float
) -> pa.RecordBatch | None:
    """Links and one edge at most of each class of a pair of blocks.

    ``sides`` tells the blocks apart: -1 for the classes of a block that is alone, whose
    pairs all count, else 0 and 1, where only pairs across count.
    """
    linked = vectors @ vectors.T >= cosine
    np.fill_diagonal(linked, False)
    if sides[0] >= 0:
        linked &= sides[:, None] != sides[None, :]
    for earlier in range(table):  # counted there
        linked &= keys[:, None, earlier] != keys[None, :, earlier]
    links = linked @ copies
    some = np.flatnonzero(links)
    if not len(some):
        return None
    # A tree over each connected part: every class but the first of a part has one edge to it.
    first = np.full(len(cids), -1)
    for i in some:
        if first[i] < 0:
            todo = np.array([i])
            first[i] = i
            while len(todo):
                todo = np.flatnonzero(linked[todo].any(0) & (first < 0))
                first[todo] = i
    out = [cids[some], links[some].astype(np.int64), cids[first[some]]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["cid", "links", "other"])


def _links(entries: DataFrame, classes: DataFrame, coded: DataFrame, dims: int, cosine: float, block: int) -> DataFrame:
    """(cid, links, other) from the classes left in each bucket."""
    tasks = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = entries.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("table", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = entries.join(sizes, ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    full = placed.join(classes.select("cid", "copies", "vector"), "cid").join(coded.select("cid", "keys"), "cid")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    meet = full.select("*", other).select(
        "table", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "cid", "copies", "vector", "keys",
    )
    where = ["table", "key", "low", "high"]
    dealt = meet.repartition(tasks, *where).sortWithinPartitions(*where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            if len(whole) < 2:
                return
            vectors = _matrix(whole["vector"].chunk(0), dims)
            own = whole["own"].to_numpy()
            sides = np.full(len(own), -1) if now[2] == now[3] else (own == now[3]).astype(int)
            keys = whole["keys"].chunk(0)
            keys = keys.flatten().to_numpy().reshape(len(keys), -1)
            made = _block_links(
                vectors, whole["cid"].to_numpy(), whole["copies"].to_numpy(), keys, sides, now[0], cosine
            )
            if made is not None:
                yield made

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in where), strict=True))
            start = 0
            while start < len(rows):
                end = start
                while end < len(rows) and rows[end] == rows[start]:
                    end += 1
                if rows[start] != now:
                    if parts:
                        yield from flush()
                    now, parts = rows[start], []
                parts.append(batch.slice(start, end - start))
                start = end
        if parts:
            yield from flush()

    return dealt.mapInArrow(run, LINKS)


def neighbours(
    vectors: DataFrame,
    cosine: float = COSINE,
    sample: int = SAMPLE,
    recall: float = RECALL,
    small: int = SMALL,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashed = _hashed(vectors)
    rows = stored(hashed.select("vec_id", "a", "b"), "hashes")
    classes = stored(classes_of(hashed).withColumn("cid", F.monotonically_increasing_id()), "classes")
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if not facts["n"]:
        return _labelled(rows, classes, spark.createDataFrame([], LINKS))
    dims = facts["dims"]
    chosen = classes.orderBy("a", "b").limit(sample).select("vector").toArrow()["vector"].combine_chunks()
    quantiser = fit(_matrix(chosen, dims), facts["n"], cosine, recall)
    coded = stored(_coded(classes, quantiser, dims), "codes")
    entries = _entries(coded, quantiser)
    sizes = entries.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = stored(entries.join(sizes, ["table", "key"]), "several")
    left = _with_company(several.where(F.col("n") <= small), quantiser.reach, tasks)
    left = stored(left.unionByName(several.where(F.col("n") > small).select("cid", "table", "key")), "left")
    return _labelled(rows, classes, stored(_links(left, classes, coded, dims, cosine, block), "links"))


def _labelled(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    edges = links.where("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    comps = components(edges)
    named = (
        classes.select("a", "b", "cid", "copies")
        .join(counts, "cid", "left")
        .join(comps, "cid", "left")
        .select("a", "b", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "cid").alias("comp"))
    )
    used = rows.where("a is not null").select("vec_id", "a", "b").join(named, ["a", "b"])
    least = used.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    linked = used.join(least, "comp").select(
        "vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    alone = rows.where("a is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", kept)


def op11_itq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"))
