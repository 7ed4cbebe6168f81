import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm.registry import QUERIES
from tallyframe.llm.token_rollups import BYTES, WORDS, Rollups, changes, image, revised, token_count
from tallyframe.llm.tokens import BYTE_BPE, WORD_BPE, Encoder

from tests.llm.helpers import DATA, folder_of, sql_rows, table

ROWS = [
    (1, "one two", "en", "a"), (2, "three", "en", "a"), (3, None, None, None), (3, None, None, None),
    (4, "x " * 50_000, "de", "a"),
]


def words(version=WORDS):
    return image(version, token_count(F.col("text"), version))


def totals(rollups):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollups.totals().collect()}


def test_changes_add_up_and_batches_count_once(spark, tmp_path):
    docs = table(spark, ROWS, "5 as N_TOKENS")
    rollups = Rollups(spark, f"file://{tmp_path}/rollups")
    assert totals(rollups) == {}
    insert = changes(docs, None, words())
    assert rollups.commit("1", insert)
    assert not rollups.commit("1", insert)
    first = {("a", "en", WORDS): (2, 3), (None, None, WORDS): (2, 0), ("a", "de", WORDS): (1, 50_000)}
    assert totals(rollups) == first
    assert rollups.commit("2", changes(docs.where("doc_id = 4"), words(), words(BYTES)))
    assert rollups.commit("3", changes(docs.where("doc_id = 1"), words(), None))
    assert rollups.commit("4", changes(docs.limit(0), None, words()))
    want = {("a", "en", WORDS): (1, 1), (None, None, WORDS): (2, 0), ("a", "de", BYTES): (1, 100_000)}
    assert totals(rollups) == want
    rollups.compact()
    assert totals(rollups) == want
    again = Rollups(spark, f"file://{tmp_path}/rollups")
    for batch in "1234":
        assert not again.commit(batch, insert)
    assert totals(again) == want


def test_a_batch_that_failed_before_its_commit_runs_anew(spark, tmp_path):
    docs = table(spark, ROWS)
    rollups = Rollups(spark, f"file://{tmp_path}/rollups")
    broken = changes(docs, None, image(WORDS, F.raise_error(F.lit("lost")).cast("long")))
    try:
        rollups.commit("1", broken)
        raise AssertionError("the batch was to fail")
    except AssertionError:
        raise
    except Exception:  # noqa: BLE001, S110  what Spark raises
        pass
    assert totals(rollups) == {}
    assert rollups.commit("1", changes(docs, None, words()))


def test_counts_of_a_real_tokenizer(spark):
    docs = table(spark, [r for r in ROWS if r[1]])
    got = docs.select("text", token_count(F.col("text"), "byte-bpe", BYTE_BPE).alias("n")).collect()
    assert all(r.n == len(Encoder(BYTE_BPE).ids(r.text)) // 4 for r in got)


def brute(rows):
    """Counts of documents and tokens by key, once all but the last copies are under the second tokenizer."""
    keep = {}
    for i, (doc_id, t, *_) in enumerate(rows):
        if t not in keep or (rows[keep[t]][0] or -1) <= (doc_id or -1):
            keep[t] = i
    want = Counter()
    for version, path in (("byte_bpe_50k", BYTE_BPE), ("word_bpe_49k", WORD_BPE)):
        whole = Tokenizer.from_file(path)
        for i, (_, t, lang, source) in enumerate(rows):
            if version == "byte_bpe_50k" or keep[t] == i:
                want[(source, lang, version), 0] += 1
                want[(source, lang, version), 1] += len(whole.encode(t, add_special_tokens=False).ids)
    return {k: (want[k, 0], want[k, 1]) for k, _ in want}


def found(df):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in df.collect()}


def test_query_on_odd_documents(spark, tmp_path):
    rows = [*ROWS, (6, "three", "en", "b"), (7, "漢字漢字 without-spaces <|endoftext|>", "zh", "a"), (8, None, "en", "a"), (9, "", "en", "a")]
    folder = folder_of(table(spark, rows, "1 as DIGEST"), tmp_path)
    want = brute([(i, t or "", lang, source) for i, t, lang, source in rows])
    assert found(QUERIES["op2_token_rollups"](spark, folder)) == want
    folder = folder_of(table(spark, rows).limit(0), tmp_path / "empty")
    assert found(QUERIES["op2_token_rollups"](spark, folder)) == {}


def test_query_on_the_given_documents(spark):
    df = QUERIES["op2_token_rollups"](spark, f"{DATA}/sf0.001")
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    assert found(df) == brute([(r.doc_id, r.text or "", r.lang, r.source) for r in docs])


#: The same job from words to bytes, which SQL can count.
SQL = """
WITH rows AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents
), keep AS (
  SELECT t, max(doc_id) AS keep_id FROM rows GROUP BY t
)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS n_docs,
       CAST(sum(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n_tokens
FROM rows GROUP BY source, lang
UNION ALL
SELECT source, lang, 'utf8-bytes-1', count(*), CAST(sum(strlen(t)) AS BIGINT)
FROM rows JOIN keep USING (t) WHERE doc_id = keep_id GROUP BY source, lang
"""


def test_words_and_bytes_match_sql(spark):
    df = revised(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), WORDS, BYTES)
    _, result = sql_rows(f"{DATA}/sf0.01", SQL, ["documents"])
    names = [c[0] for c in result.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())


def batches(spark, n):
    """Batches with ids of 40 characters and more, and odd ones."""
    docs = table(spark, ROWS[:2]).coalesce(1)
    ids = [f"{'batch of a very long name':>40} {i}" for i in range(n - 3)] + ["a/b", "a+b=c", "é漢" * 100]
    return ids, changes(docs, None, words())


def test_many_long_ids_survive_compaction(spark, tmp_path):
    ids, batch = batches(spark, 50)
    rollups = Rollups(spark, f"file://{tmp_path}/rollups")
    for i, batch_id in enumerate(ids):
        assert rollups.commit(batch_id, batch)
        if i % 20 == 7:
            assert rollups.compact()
    want = {("a", "en", WORDS): (100, 150)}
    assert totals(rollups) == want
    assert rollups.compact() and not rollups.compact()
    assert totals(rollups) == want
    rollups.sweep()
    again = Rollups(spark, f"file://{tmp_path}/rollups")
    assert totals(again) == want
    assert not any(again.commit(batch_id, batch) for batch_id in (ids[0], ids[7], *ids[-3:]))
    assert totals(again) == want


class Lost(Exception):
    pass


STEPS = ("_write_delta", "_write_list", "_publish", "_remove")


@pytest.mark.parametrize("after", [False, True], ids=["before", "after"])
@pytest.mark.parametrize("step", STEPS)
def test_a_driver_lost_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step, after):
    ids, batch = batches(spark, 5)
    folder = f"file://{tmp_path}/rollups"
    rollups = Rollups(spark, folder)
    for batch_id in ids[:3]:
        assert rollups.commit(batch_id, batch)
    rollups.compact()
    assert rollups.commit(ids[3], batch)
    want = totals(rollups)
    work = getattr(Rollups, step)

    def lost(self, *args):
        if after:
            work(self, *args)
        raise Lost

    monkeypatch.setattr(Rollups, step, lost)
    with pytest.raises(Lost):
        Rollups(spark, folder).compact()
        Rollups(spark, folder).sweep()
    monkeypatch.undo()
    rollups = Rollups(spark, folder)
    assert totals(rollups) == want
    assert not any(rollups.commit(batch_id, batch) for batch_id in ids[:4])
    rollups.compact()
    rollups.sweep()
    assert totals(rollups) == want
    assert rollups.commit(ids[4], batch) and not rollups.commit(ids[4], batch)
    assert totals(rollups) == {("a", "en", WORDS): (10, 15)}


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    """Both have written their delta before either publishes it."""
    _, batch = batches(spark, 4)
    rollups = Rollups(spark, f"file://{tmp_path}/rollups")
    meet, publish, said = threading.Barrier(2), Rollups._publish, []

    def together(self, own, name):
        meet.wait(60)
        return publish(self, own, name)

    monkeypatch.setattr(Rollups, "_publish", together)
    threads = [threading.Thread(target=lambda: said.append(rollups.commit("one", batch))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(said) == [False, True]
    assert totals(rollups) == {("a", "en", WORDS): (2, 3)}
    monkeypatch.undo()
    assert not rollups.commit("one", batch)


def test_a_writer_that_comes_after_the_sweep_counts_for_nothing(spark, tmp_path, monkeypatch):
    _, batch = batches(spark, 4)
    rollups = Rollups(spark, f"file://{tmp_path}/rollups")
    publish = Rollups._publish

    def late(self, own, name):
        monkeypatch.undo()
        other = Rollups(spark, rollups.folder)
        assert other.commit("one", batch) and other.compact()
        other._remove(name)  # what a sweep removes
        return publish(self, own, name)

    monkeypatch.setattr(Rollups, "_publish", late)
    assert not rollups.commit("one", batch)
    assert totals(rollups) == {("a", "en", WORDS): (2, 3)}
