import glob
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from tallyframe.llm.columns import read
from tallyframe.llm.token_files import Reader, Writer, op9_zstd_token_files, read_token_files, write_token_files
from tallyframe.llm.tokens import WORD_BPE

from tests.llm.helpers import DATA, table


def file_of(docs, frame_ids=10):
    out = io.BytesIO()
    writer = Writer(out, frame_ids=frame_ids)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, "<u4").tobytes())
    writer.close()
    return out.getvalue()


DOCS = [(None, [7]), (1, [1, 2, 3]), (1, []), (5, list(range(40))), (9, [4] * 12), (12, [1])]


def test_round_trip_and_plain_decoding():
    data = file_of(DOCS)
    reader = Reader(pa.BufferReader(data))
    got = [x for i in range(len(reader.frames)) for x in reader.frame(i)]
    assert got == [(d, np.array(x, "<u4").tobytes()) for d, x in DOCS]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(plain) == sum(full for _, _, full, _ in reader.frames)


def test_only_frames_asked_for_are_read():
    reader = Reader(pa.BufferReader(file_of(DOCS)))
    opened = []
    frame = reader.frame
    reader.frame = lambda i: opened.append(i) or frame(i)
    assert [d for d, _ in reader.documents({9})] == [9]
    assert len(opened) < len(reader.frames)


def test_damage_is_found():
    data = bytearray(file_of(DOCS))
    offset, size, *_ = Reader(pa.BufferReader(bytes(data))).frames[1]
    data[offset + size - 6] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        Reader(pa.BufferReader(bytes(data))).frame(1)
    with pytest.raises(ValueError, match="seek table"):
        Reader(pa.BufferReader(bytes(data[:-1])))


def expected(rows):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    out, start = [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_matches_the_tokenizer(spark):
    sf_dir = f"{DATA}/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    got = sorted(map(tuple, op9_zstd_token_files(spark, sf_dir).collect()))
    assert got == expected(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "first"), (-3, None), (2, ""), (7, "Some Words " * 30_000), (8, "a"), (8, "a")]
    docs = table(spark, rows[::-1], "1 as IDS")
    folder = f"file://{tmp_path}/files"
    files = write_token_files(docs, folder, frame_ids=50)
    got = sorted((r.start, r.doc_id, bytes(r.ids)) for r in read_token_files(files, folder).collect())
    assert [(d, s, len(i) // 4, zlib.crc32(i)) for s, d, i in got] == expected(rows)
    assert not glob.glob(f"{tmp_path}/files/*.tmp")
    none = f"file://{tmp_path}/none"
    assert read_token_files(write_token_files(docs.limit(0), none), none).count() == 0
