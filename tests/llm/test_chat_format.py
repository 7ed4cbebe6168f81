import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm.chat_format import (
    Segment,
    digests,
    escape,
    format_chats,
    masked_text,
    parse,
    unescape,
    with_control_case,
)
from tallyframe.llm.tokens import BYTE_BPE

TEXT = st.text(alphabet="\\<|>endoftext# :\n é漢😀", max_size=30)


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|endoftext|>", "a\\"]), TEXT), min_size=1))
def test_a_conversation_reads_back(turns):
    segment = Segment(1)
    for role, text in turns:
        segment.add(role, text)
    row = segment.encoded(BYTE_BPE, last=True)
    assert parse(row["formatted"]) == turns
    starts, ends = (np.frombuffer(row[c], "<u4") for c in ("starts", "ends"))
    loss = masked_text(row["formatted"], starts, ends, np.frombuffer(row["mask"], np.uint8))
    assert loss == "".join(t for r, t in turns if r == "assistant")


@settings(deadline=None)
@given(TEXT)
def test_escaping_is_reversible_and_hides_the_marker(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)


ROWS = [
    (1, 1, "assistant", "second"), (1, 0, "user", "first"), (1, 2, "assistant", None), (2, 0, None, "x" * 90_000),
    (None, 5, "assistant", "no id"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"),
]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as SEGMENT").repartition(3)


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        n, turns, loss = out.get(conv, (0, "", ""))
        loss += (text or "") if role == "assistant" else ""
        out[conv] = (n + 1, turns + f"{role or ''}\n{text or ''}\n", loss)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(t), len(x), sha(x)) for c, (n, t, x) in out.items()}


def read_back(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(df).collect()}


def test_odd_rows_whole_and_in_segments(spark):
    for segment in (1 << 22, 1):
        assert read_back(format_chats(table(spark), segment=segment)) == expected(ROWS)
    assert digests(format_chats(table(spark).limit(0))).count() == 0


def test_segments_have_the_ids_of_the_whole(spark):
    rows = [(4, i, "assistant" if i % 2 else "user", f" turn {i} \n\n") for i in range(9)]
    parts = sorted(format_chats(table(spark, rows), segment=1).collect(), key=lambda r: r.segment)
    assert len(parts) == 9
    whole = Tokenizer.from_file(BYTE_BPE).encode("".join(p.formatted for p in parts), add_special_tokens=False)
    assert b"".join(bytes(p.ids) for p in parts) == np.array(whole.ids, "<u4").tobytes()


def test_control_strings(spark):
    (row,) = with_control_case(table(spark).limit(0)).transform(format_chats).transform(digests).collect()
    text = "\\### Assistant: </turn> ok"
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, len(text))
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_turns_inside_a_conversation_in_segments(spark):
    texts = ["a", None, "", "b <|", "", None, "c", ""]
    rows = [(c, t, "assistant" if t % 2 else None, x) for c in (5, None) for t, x in enumerate(texts)]
    rows += [(6, None, "user", ""), (6, -3000, "assistant", ""), (6, 1 << 60, "user", None), (6, (1 << 60) + 1, "user", "")]
    key = lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {}
    for conv in (5, None, 6):
        own = [(r[0], i, *r[2:]) for i, r in enumerate(sorted((r for r in rows if r[0] == conv), key=key))]
        want |= expected(own)
    for segment in (1, 60, 1 << 22):
        assert read_back(format_chats(table(spark, rows), segment=segment)) == want


def test_segments_of_one_conversation_are_made_in_different_tasks(spark):
    rows = [(4, i, "assistant" if i % 2 else "user", "word " * 20 if i % 3 else "") for i in range(3000)]
    parts = format_chats(table(spark, rows), segment=4000).withColumn("task", F.spark_partition_id())
    got = parts.select("segment", "last", "task", F.length("formatted").alias("n")).orderBy("segment").collect()
    assert len({r.task for r in got}) > 1
    assert [r.last for r in got] == [False] * (len(got) - 1) + [True]
    assert max(r.n for r in got) < 4000 + 200 and len(got) >= sum(r.n for r in got) // 4200
    assert read_back(format_chats(table(spark, rows), segment=4000)) == expected(rows)
