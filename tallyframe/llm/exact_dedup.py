"""Exact dedup by composable polynomial fingerprints.

A text is cut into chunks. A chunk of bytes b0..bn-1 has the hash
``sum(b[i] * x**(n-1-i)) mod p`` under two primes, and the hash of a longer text
follows from those of its parts: ``h(AB) = h(A) * x**len(B) + h(B)``. So all chunks
of a block are hashed at once, as one product of a byte matrix with the powers of
``x``, and the chunk hashes are combined afterwards, however large the document is.

Fingerprints only propose groups. The texts of every proposed group are then
compared chunk by chunk: per group and chunk number the smallest and largest chunk
must be the same bytes. Both are kept on the map side, so a group that holds a third
of all rows reaches the shuffle as one row per chunk and task. Groups that fail the
comparison (different texts of one fingerprint) are grouped again by their whole
texts.

Defined results: a null text counts as empty; texts are equal when they are identical
after lower-casing A-Z; the row with the largest doc_id stays, a null doc_id counting
as the smallest; of rows that repeat both doc_id and text one is marked as kept.
An empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyframe.llm.columns import LOWER_ASCII, appended, free_name, read
from tallyframe.llm.scratch import stored

#: Two primes below 2**31 and a base for each: a byte times a power stays below 2**39,
#: so a chunk of up to 2**24 bytes sums in 64 bits without a reduction.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_220_703_125)
CHUNK = 4096
#: Bytes of a document that are lower-cased and hashed at a time.
BLOCK = 1 << 20
#: Bytes of the pieces that the comparison works on.
PIECE = 1 << 16

PRINT = ("fp_a", "fp_b", "fp_len")
PRINT_DDL = "fp_a long, fp_b long, fp_len long"


class Fingerprinter:
    def __init__(self, primes=PRIMES, bases=BASES, chunk=CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        self.powers = []
        for p, x in zip(primes, bases, strict=True):
            row = np.empty(chunk, np.uint64)
            value = 1
            for i in range(chunk - 1, -1, -1):
                row[i] = value
                value = value * x % p
            self.powers.append(row)

    def combine(self, a: tuple[int, ...], b: tuple[int, ...], len_b: int) -> tuple[int, ...]:
        """The hashes of AB from those of A and B."""
        return tuple(
            (ha * pow(x, len_b, p) + hb) % p
            for ha, hb, x, p in zip(a, b, self.bases, self.primes, strict=True)
        )

    def block(self, data: bytes) -> tuple[int, ...]:
        """The hashes of a block: all its chunks in one product each, then combined."""
        whole = len(data) // self.chunk * self.chunk
        raw = np.frombuffer(data, np.uint8)
        out = (0,) * len(self.primes)
        if whole:
            rows = raw[:whole].reshape(-1, self.chunk).astype(np.uint64)
            hashes = [(rows @ w) % np.uint64(p) for w, p in zip(self.powers, self.primes, strict=True)]
            for chunk in zip(*(h.tolist() for h in hashes), strict=True):
                out = self.combine(out, chunk, self.chunk)
        if n := len(data) - whole:
            rest = raw[whole:].astype(np.uint64)
            tail = tuple(
                int(rest @ w[-n:]) % p for w, p in zip(self.powers, self.primes, strict=True)
            )
            out = self.combine(out, tail, n)
        return out

    def text(self, data: bytes) -> tuple[tuple[int, ...], str]:
        """The hashes and the SHA-256 of the lower-cased text, in one pass over its blocks."""
        out, digest = (0,) * len(self.primes), hashlib.sha256()
        view = memoryview(data)
        for start in range(0, len(data), BLOCK):
            block = bytes(view[start : start + BLOCK]).translate(LOWER_ASCII)
            digest.update(block)
            out = self.combine(out, self.block(block), len(block))
        return out, digest.hexdigest()


def with_fingerprints(docs: DataFrame, printer: Fingerprinter | None = None) -> DataFrame:
    """``docs`` with fp_a, fp_b, fp_len (UTF-8 bytes) and text_sha256."""
    printer = printer or Fingerprinter()

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        a, b, n, sha = [], [], [], []
        for scalar in batch.column("text"):
            data = scalar.as_py()
            data = data.encode() if data else b""
            (ha, hb), hexed = printer.text(data)
            a.append(ha)
            b.append(hb)
            n.append(len(data))
            sha.append(hexed)
        return {
            "fp_a": pa.array(a, pa.int64()),
            "fp_b": pa.array(b, pa.int64()),
            "fp_len": pa.array(n, pa.int64()),
            "text_sha256": pa.array(sha, pa.string()),
        }

    return appended(docs, f"{PRINT_DDL}, text_sha256 string", make)


def _pieces(df: DataFrame) -> DataFrame:
    """(fingerprint, piece number, lower-cased bytes) of every text, a piece at a time."""
    schema = f"{PRINT_DDL}, piece long, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = list(zip(*(batch.column(c).to_pylist() for c in PRINT), strict=True))
            for fp, scalar in zip(prints, batch.column("text"), strict=True):
                data = (scalar.as_py() or "").encode()
                for first in range(0, len(data), BLOCK):
                    block = data[first : first + BLOCK].translate(LOWER_ASCII)
                    parts = [block[i : i + PIECE] for i in range(0, len(block), PIECE)]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v] * n, pa.int64()) for v in fp]
                        + [
                            pa.array(range(first // PIECE, first // PIECE + n), pa.int64()),
                            pa.array(parts, pa.binary()),
                        ],
                        names=[*PRINT, "piece", "bytes"],
                    )

    return df.mapInArrow(run, schema)


def exact_groups(docs: DataFrame, printer: Fingerprinter | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and the fingerprint.

    ``part`` tells apart different texts of one fingerprint; it is null where there is one text.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    rows = stored(with_fingerprints(texts, printer).drop("text"), "prints")
    repeated = rows.groupBy(*PRINT).count().where("count > 1")
    suspects = rows.join(repeated, list(PRINT), "left_semi").select("doc_id", "hash", *PRINT).distinct()
    suspects = suspects.withColumnsRenamed({c: f"s_{c}" for c in ("doc_id", "hash", *PRINT)})
    # By the hash too: rows that share an id, such as null, meet their own fingerprint only.
    own = texts["doc_id"].eqNullSafe(suspects["s_doc_id"]) & (texts["hash"] == suspects["s_hash"])
    texts = texts.join(suspects, own).select(
        "doc_id", "text", *[F.col(f"s_{c}").alias(c) for c in PRINT]
    )
    compared = (
        _pieces(texts)
        .groupBy(*PRINT, "piece")
        .agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
        .where("low <> high")
        .select(*PRINT)
        .distinct()
    )
    clashes = stored(compared, "clashes")
    rows = rows.drop("hash").withColumn("part", F.lit(None).cast("string"))
    if not clashes.isEmpty():
        rows = _split_clashes(docs, rows, clashes, printer)
    return _choose(rows)


def _split_clashes(docs, rows, clashes, printer) -> DataFrame:
    """``rows``, those of clashing fingerprints made anew with their whole text as part."""
    lower = F.translate(
        F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    printed = with_fingerprints(docs.select("doc_id", "text"), printer)
    apart = printed.join(clashes, list(PRINT), "left_semi").withColumn("part", lower).drop("text")
    fine = rows.join(clashes, list(PRINT), "left_anti")
    return fine.unionByName(apart)


def _choose(rows: DataFrame) -> DataFrame:
    keys = [*PRINT, "part"]
    groups = rows.groupBy(*keys).agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = groups.withColumnsRenamed({c: f"g_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same = same & (rows[c].eqNullSafe(groups[f"g_{c}"]) if c == "part" else rows[c] == groups[f"g_{c}"])
    joined = rows.join(groups, same, "left").drop(*[f"g_{c}" for c in keys])
    # Of rows that repeat doc_id and text, the first one counts.
    turn = F.row_number().over(
        Window.partitionBy("doc_id", *keys).orderBy("text_sha256")
    )
    return joined.withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (turn == 1)
    )


@F.pandas_udf(StringType())
def _sha256(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: hashlib.sha256((t or "").encode().translate(LOWER_ASCII)).hexdigest()
    )


def drop_copies(docs: DataFrame, printer: Fingerprinter | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = exact_groups(docs, printer)
    stay = stored(
        groups.where("kept").select(
            F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha")
        ),
        "kept",
    )
    sha = free_name(docs.columns, "text_sha256")
    printed = docs.withColumn(sha, _sha256(F.col("text")))
    kept = printed.join(
        stay, printed["doc_id"].eqNullSafe(F.col("k_id")) & (printed[sha] == F.col("k_sha")), "left_semi"
    )
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", sha])  # rows that repeat id and text
    return kept.drop(sha)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM lowered
"""
