"""Token counts as rollups that signed changes keep up to date.

A table of totals by source, language and tokenizer version lives as committed deltas in
a folder. A batch of changes holds, for each changed document, its count before (none
for an insert) and after (none for a delete); a revised count has both, which may differ
in any key, such as the tokenizer version. The batch becomes one delta: minus one
document and minus its tokens under the key before, plus both under the key after. It is
summed by key on the map side, so a source of a third of all rows is a few rows by the
time it reaches the shuffle. Totals are the sum of the deltas; no state of a document is
ever read.

A batch is committed once. Its delta is written to a folder with a name of its own, which
is then renamed to the name of the batch (a digest of its id, so that ids may be of any
length). Where two writers meet, a file system puts the later folder inside the earlier
one instead of in its place; the writer finds it there, takes it away and reports False.
Running a batch again after a failure, or twice, changes nothing. This needs a file system
whose folders are renamed in one step (HDFS, a local disk), not an object store.

``compact`` folds deltas into one. A fold is a folder with the totals and a list of the
batches that they cover, published by one rename under the next number. Readers take the
latest fold and the deltas that it does not cover; so a fold that fails at any step changes
nothing, and commits may go on beside it. ``sweep`` removes what the latest fold covers; run
it without readers of older state.

Defined results: null source or language is a key of its own; a null text has 0 tokens;
repeated rows count as often as they are there; an empty batch is committed without
effect; keys without documents and tokens are left out of the totals; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyframe.llm.columns import read
from tallyframe.llm.scratch import new_dir, stored
from tallyframe.llm.tokens import BYTE_BPE, WORD_BPE, encoder

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
WORDS, BYTES = "words-1", "utf8-bytes-1"
BYTE_VERSION, WORD_VERSION = "byte_bpe_50k", "word_bpe_49k"


def token_count(text: Column, version: str, tokenizer: str | None = None) -> Column:
    """Tokens of a text under a tokenizer version; any other version names a tokenizer file."""
    filled = F.coalesce(text, F.lit(""))
    if version == WORDS:
        return F.regexp_count(filled, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    if version == BYTES:
        return F.octet_length(filled).cast("long")
    if tokenizer is None:
        raise ValueError(f"no tokenizer file for version {version}")
    count = F.pandas_udf(
        lambda texts: texts.map(lambda t: len(encoder(tokenizer).ids(t)) // 4).astype("int32"), IntegerType()
    )
    return count(filled).cast("long")


def image(version: str, tokens: Column) -> Column:
    """What is counted for a document, before or after a change."""
    return F.struct(
        F.col("source").alias("source"),
        F.col("lang").alias("lang"),
        F.lit(version).alias("tokenizer_version"),
        tokens.alias("n_tokens"),
    )


def changes(rows: DataFrame, before: Column | None, after: Column | None) -> DataFrame:
    """Changes (before, after) of documents: an insert has no ``before``, a delete no ``after``."""
    none = F.lit(None).cast("struct<source:string,lang:string,tokenizer_version:string,n_tokens:bigint>")
    return rows.select(
        (none if before is None else before).alias("before"), (none if after is None else after).alias("after")
    )


def delta_of(batch: DataFrame) -> DataFrame:
    """The signed sums of a batch by key."""
    signed = batch.select(
        F.explode(
            F.array(
                F.struct(F.lit(-1).alias("sign"), F.col("before").alias("image")),
                F.struct(F.lit(1).alias("sign"), F.col("after").alias("image")),
            )
        ).alias("x")
    ).where("x.image is not null")
    return (
        signed.groupBy(*[F.col(f"x.image.{k}").alias(k) for k in KEYS])
        .agg(
            F.sum("x.sign").alias("n_docs"),
            F.sum(F.col("x.sign") * F.col("x.image.n_tokens")).alias("n_tokens"),
        )
        .where("n_docs <> 0 or n_tokens <> 0")
    )


class Rollups:
    """Totals in ``folder``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Steps on the file system; none is silent about a failure.

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def _names(self, name: str) -> list[str]:
        if not self._there(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{name}")))

    def _remove(self, name: str) -> None:
        if not self._fs.delete(self._path(f"{self.folder}/{name}"), True) and self._there(name):
            raise OSError(f"{self.folder}/{name} can't be removed")

    def _write_delta(self, name: str, delta: DataFrame) -> None:
        delta.write.parquet(f"{self.folder}/{name}")

    def _write_list(self, name: str, lines: list[str]) -> None:
        self.spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.text(f"{self.folder}/{name}")

    def _publish(self, own: str, name: str) -> bool:
        """Renames staged/own to ``name``; False if that name is taken."""
        parent = name.rpartition("/")[0]
        if not self._fs.mkdirs(self._path(f"{self.folder}/{parent}")):
            raise OSError(f"{self.folder}/{parent} can't be made")
        staged, target = (self._path(f"{self.folder}/{x}") for x in (f"staged/{own}", name))
        renamed = self._fs.rename(staged, target)
        if self._there(f"{name}/{own}"):  # a folder of that name was there and took it in
            self._remove(f"{name}/{own}")
            return False
        if not renamed:
            if not self._there(name):
                raise OSError(f"{staged.toString()} can't be renamed to {name}")
            self._remove(f"staged/{own}")
        return renamed

    # Commits

    def _fold(self) -> tuple[str | None, frozenset[str]]:
        """The latest fold and the batches it covers."""
        folds = self._names("folds")
        return (folds[-1], _lines(self.spark, f"{self.folder}/folds/{folds[-1]}/covers")) if folds else (None, frozenset())

    def committed(self, batch_id: str) -> bool:
        name = _name(batch_id)
        return self._there(f"committed/{name}") or name in self._fold()[1]

    def commit(self, batch_id: str, batch: DataFrame) -> bool:
        """Adds a batch; False if a batch of this id is there already."""
        if not batch_id:
            raise ValueError("a batch needs an id")
        if self.committed(batch_id):
            return False
        own, name = uuid.uuid4().hex, _name(batch_id)
        self._write_delta(f"staged/{own}/delta", delta_of(batch))
        if not self._publish(own, f"committed/{name}"):
            return False
        # Another writer's delta may have been folded and swept meanwhile; then this one counts for nothing.
        if name in self._fold()[1]:
            self._remove(f"committed/{name}")
            return False
        return True

    def compact(self) -> bool:
        """Folds the deltas that are there into one; False if there is nothing to fold, or another fold came first."""
        last, covered = self._fold()
        names = self._names("committed")
        if not set(names) - covered:
            return False
        own = uuid.uuid4().hex
        self._write_delta(f"staged/{own}/delta", self._summed(last, [n for n in names if n not in covered]))
        self._write_list(f"staged/{own}/covers", sorted(covered | set(names)))
        number = int(last) + 1 if last else 1
        return self._publish(own, f"folds/{number:012d}")

    def sweep(self) -> None:
        """Removes deltas that the latest fold covers, older folds, and what failed runs have left."""
        last, covered = self._fold()
        for name in self._names("committed"):
            if name in covered:
                self._remove(f"committed/{name}")
        for name in self._names("folds")[:-1]:
            self._remove(f"folds/{name}")
        for name in self._names("staged"):
            self._remove(f"staged/{name}")

    def _summed(self, fold: str | None, names: list[str]) -> DataFrame:
        paths = [f"{self.folder}/committed/{n}/delta" for n in names]
        paths += [f"{self.folder}/folds/{fold}/delta"] if fold else []
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        return (
            self.spark.read.schema(DELTA)
            .parquet(*paths)
            .groupBy(*KEYS)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .where("n_docs <> 0 or n_tokens <> 0")
        )

    def totals(self) -> DataFrame:
        last, covered = self._fold()
        return self._summed(last, [n for n in self._names("committed") if n not in covered])


def _name(batch_id: str) -> str:
    return hashlib.sha256(batch_id.encode()).hexdigest()


@functools.lru_cache(maxsize=8)
def _lines(spark: SparkSession, path: str) -> frozenset[str]:
    """The lines of a list that never changes; one for each batch."""
    return frozenset(r["value"] for r in spark.read.text(path).collect())


def revised(docs: DataFrame, before: str, after: str, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """Totals once all documents are inserted, revised to another tokenizer version, and their copies deleted.

    Every text is counted once per version. Every batch is sent twice, as after a failure
    between commit and reply. Of equal texts the document with the largest doc_id stays (a
    null id is the smallest; one of them stays).
    """
    files = tokenizers or {}
    old, new = (token_count(F.col("text"), v, files.get(v)) for v in (before, after))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    counted = stored(docs.select("doc_id", "source", "lang", digest, old.alias("old"), new.alias("new")), "counts")
    first, second = image(before, F.col("old")), image(after, F.col("new"))
    # Deleting all documents and inserting one of each text again deletes the copies. No join
    # looks up the one that stays, so a text that a third of all rows share is no hot key.
    stays = F.struct("doc_id", "source", "lang", "old", "new")
    kept = counted.groupBy("digest").agg(F.max(stays).alias("row")).select("row.*")
    rollups = Rollups(docs.sparkSession, new_dir(docs.sparkSession, "rollups"))
    batches = {
        "1-insert": changes(counted, None, first),
        "2-revise": changes(counted, first, second),
        "3-insert-again": changes(counted, None, first),
        "4-delete-copies": changes(counted, second, None).unionByName(changes(kept, None, second)),
    }
    for batch_id, batch in batches.items():
        rollups.commit(batch_id, batch)
        rollups.commit(batch_id, batch)
        rollups.compact()
    rollups.sweep()
    return rollups.totals()


def op2_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``revised`` from the byte-level to the word-level public tokenizer."""
    tokenizers = {BYTE_VERSION: BYTE_BPE, WORD_VERSION: WORD_BPE}
    return revised(read(spark, sf_dir, "documents"), BYTE_VERSION, WORD_VERSION, tokenizers)
