"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, each with its own checksum and holding
whole documents, followed by two skippable frames: an index (first document and number
of documents of each frame) and the seek table of the public seekable format (sizes and
XXH64 checksum of each frame, then its footer). Any zstandard reader decodes a file; a
reader of some documents reads the tail, picks their frames and decompresses only those.

Documents are put into ascending doc_id order by a range exchange, one file for each
range. A task writes its file under a name of its own and then moves it into place, so a
task that runs again leaves the same file. Files are opened through ``pyarrow.fs``, which
takes the shared folder's URI on every kind of store.

Defined results: a null text is empty and has the end id only; a null doc_id comes first;
rows that repeat an id are written one by one, in the order of their text's hash; an empty
table gives files without documents and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.columns import read
from tallyframe.llm.scratch import new_dir, stored
from tallyframe.llm.tokens import WORD_BPE, encoder

END_ID = 1
#: A frame closes when it holds so many ids.
FRAME_IDS = 1 << 16
LEVEL = 3

# Fixed values of the zstandard formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

NO_ID = -(1 << 63)  # stands for a null doc_id


@dataclass
class Frame:
    """Documents of a frame under construction."""

    doc_ids: list[int] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)
    size: int = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.parts.append(ids)
        self.size += len(ids) // 4

    def content(self) -> bytes:
        lengths = np.array([len(p) // 4 for p in self.parts], "<u4")
        head = struct.pack("<I", len(self.parts)) + np.array(self.doc_ids, "<i8").tobytes()
        return head + lengths.tobytes() + b"".join(self.parts)


def read_frame(content: bytes) -> list[tuple[int | None, bytes]]:
    (n,) = struct.unpack_from("<I", content)
    doc_ids = np.frombuffer(content, "<i8", n, 4).tolist()
    ends = np.cumsum(np.frombuffer(content, "<u4", n, 4 + 8 * n).astype(np.int64) * 4) + 4 + 12 * n
    starts = [4 + 12 * n, *ends[:-1].tolist()]
    return [
        (None if d == NO_ID else d, content[a:b])
        for d, a, b in zip(doc_ids, starts, ends.tolist(), strict=True)
    ]


class Writer:
    def __init__(self, out, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids, self.frame = out, frame_ids, Frame()
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int]] = []
        self.docs = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.frame.add(doc_id, ids)
        self.docs += 1
        self.ids += len(ids) // 4
        if self.frame.size >= self.frame_ids:
            self._close_frame()

    def _close_frame(self) -> None:
        if self.frame.parts:
            content = self.frame.content()
            packed = self.compressor.compress(content)
            self.out.write(packed)
            check = xxhash.xxh64_intdigest(content) & 0xFFFFFFFF
            self.seek.append((len(packed), len(content), check))
            self.index.append((self.frame.doc_ids[0], len(self.frame.parts)))
            self.frame = Frame()

    def close(self) -> None:
        self._close_frame()
        index = b"".join(struct.pack("<qI", *x) for x in self.index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        empty = xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF
        seek = [*self.seek, (8 + len(index), 0, empty)]
        table = b"".join(struct.pack("<III", *x) for x in seek)
        table += struct.pack("<IBI", len(seek), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)


class Reader:
    """Reads the tail of a file, and then only the frames that are asked for."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table = self._at(size - 9 - 12 * n, 12 * n)
        rows = [struct.unpack_from("<III", table, 12 * i) for i in range(n)]
        offsets = [0, *np.cumsum([r[0] for r in rows]).tolist()]
        self.frames = [(offsets[i], *rows[i]) for i in range(n - 1)]
        index = self._at(offsets[n - 1], rows[-1][0])[8:]
        self.index = [struct.unpack_from("<qI", index, 12 * i) for i in range(n - 1)]

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, i: int) -> list[tuple[int | None, bytes]]:
        offset, size, full, check = self.frames[i]
        content = zstandard.ZstdDecompressor().decompress(self._at(offset, size), max_output_size=full)
        if len(content) != full or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return read_frame(content)

    def documents(self, doc_ids: set[int]) -> Iterator[tuple[int | None, bytes]]:
        """The documents with these ids; frames that cannot hold any stay compressed."""
        firsts = [first for first, _ in self.index]
        wanted = np.array(sorted(doc_ids), np.int64)
        for i, first in enumerate(firsts):
            last = firsts[i + 1] if i + 1 < len(firsts) else (1 << 63) - 1
            if np.searchsorted(wanted, first, "left") < np.searchsorted(wanted, last, "right"):
                yield from (x for x in self.frame(i) if x[0] in doc_ids)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str = WORD_BPE, end_id: int = END_ID, frame_ids: int = FRAME_IDS
) -> DataFrame:
    """Writes the files and returns their list: part, path, docs, ids; parts are in doc_id order."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, encode = context.partitionId(), encoder(tokenizer).ids
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path = f"{root}/part-{part:06d}.zst"
        own = f"{path}.{context.taskAttemptId()}.tmp"
        with store.open_output_stream(own) as out:
            writer = Writer(out, frame_ids=frame_ids)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for doc_id, text in zip(ids, batch.column("text"), strict=True):
                    writer.add(doc_id, encode(text.as_py()) + end)
            writer.close()
        store.move(own, path)
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "file": [f"part-{part:06d}.zst"], "docs": [writer.docs], "ids": [writer.ids]}
        )

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return stored(ordered.mapInArrow(run, "part long, file string, docs long, ids long"), "files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document, from the files."""
    spark = files.sparkSession
    before, rows = 0, []
    for r in sorted(files.collect()):  # one row for each file
        rows.append((r["file"], before))
        before += r["ids"]
    listed = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                with store.open_input_file(f"{root}/{row['file']}") as file:
                    reader = Reader(file)
                    for i in range(len(reader.frames)):
                        doc_ids, parts = zip(*reader.frame(i), strict=True)
                        sizes = np.array([len(p) // 4 for p in parts], np.int64)
                        starts = start + np.append(0, np.cumsum(sizes)[:-1])
                        start += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(parts, pa.binary())],
                            names=["doc_id", "start", "ids"],
                        )

    return listed.mapInArrow(run, "doc_id long, start long, ids binary")


def op9_zstd_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "token-files")
    files = write_token_files(read(spark, sf_dir, "documents"), folder)
    return read_token_files(files, folder).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
