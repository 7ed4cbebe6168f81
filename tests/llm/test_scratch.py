import os

from tallyframe.llm import scratch


def test_stored_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_made", [])
    df = scratch.stored(spark.range(5), "five")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 3, 4]
    (path,) = (x.removeprefix("file:").replace("//", "") for x in scratch._made)
    assert os.listdir(path)
    scratch.new_dir(spark, "never-written")
    assert scratch.remove_stored(spark) == 1
    assert not os.path.exists(path) and scratch.remove_stored(spark) == 0
