"""The pipeline against the operators' brute force, stage by stage."""

from collections import Counter

import corpus_pipeline
from tallyframe.llm.columns import read
from tallyframe.llm.packing import cut_pieces
from tallyframe.llm.scratch import stored

from tests.llm.helpers import DATA, folder_of, table
from tests.llm.test_partenum_join import brute

SF = f"{DATA}/sf0.001"


def test_stages_in_order(spark):
    docs = read(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), name)
        assert out.dtypes == docs.dtypes
        docs = out
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert kept[-1].items() <= kept[-2].items()
    start, good, single, apart, mixed = kept
    dropped = [labels[i] for i in start.keys() - good.keys() if i in labels and len(start[i].split()) >= 50]
    assert all(labels.get(i, 1) for i in good) and sum(dropped) <= 0.2 * len(dropped) + 2
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    assert set(single) == set({lower(t): i for i, t in sorted(good.items())}.values())
    assert set(apart) == {least for _, _, least in brute(sorted(single.items()))}
    assert mixed
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.count() == cut_pieces(docs).count()
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(mixed)
    full = Counter()
    for r in pieces.collect():
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 1024
    whole = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole.select(columns).collect()) == sorted(pieces.select(columns).collect())


def test_odd_and_empty_tables(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, text), (4, text.upper()), (5, text + " more"), (5, text + " more"), (None, text)]
    docs = table(spark, rows)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    assert [r.doc_id for r in corpus_pipeline.run(spark, folder_of(docs, tmp_path / "a")).collect()] == [4]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, folder_of(docs.limit(0), tmp_path / "b")).count() == 0
