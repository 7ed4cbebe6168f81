from fractions import Fraction

import duckdb
import pytest

from tallyframe.llm.pfair_mix import OP4_SQL, capped_weights, keep_mixed, op4_pfair_mix, schedule, scheduled

from tests.llm.helpers import folder_of, table


@pytest.mark.parametrize("weights", [[1], [50, 50], [25, 75], [25, 6, 6, 6, 57], [1] * 20 + [80], [33, 33, 34], [1, 9999]])
def test_each_stream_is_less_than_a_block_from_its_share(weights):
    period = sum(weights)
    made = scheduled(weights, [3 * w for w in weights])
    assert [x[4] for x in made] == list(range(3 * period))
    slots = [[x[4] for x in made if x[0] == s] for s in range(len(weights))]
    for s, (w, own) in enumerate(zip(weights, slots, strict=True)):
        assert len(own) == 3 * w
        done = 0
        for t in range(3 * period + 1):
            done += t > 0 and made[t - 1][0] == s
            assert abs(done * period - w * t) < period
    for s, i, release, deadline, slot in made:
        assert release == i * period // weights[s] <= slot < deadline == -(-(i + 1) * period // weights[s])


def test_the_mix_ends_where_the_first_stream_runs_out():
    made = scheduled([1, 1], [3, 100])
    assert [sum(x[0] == s for x in made) for s in (0, 1)] == [3, 3]
    made = scheduled([1, 3], [100, 7])
    assert [sum(x[0] == s for x in made) for s in (0, 1)] == [3, 7]


def test_mix_meets_its_targets_in_bytes(spark):
    hot = [(i, "x" * 1499, "en", "hot") for i in range(600)]
    rest = [(1000 + i, "y" * 1499, "en", f"s{i % 150}") for i in range(900)]
    docs = table(spark, hot + rest)
    named, weights = capped_weights(docs)
    assert named == ["hot"] and weights == [1500 * 1500 // 4, 1500 * 1500 // 4]
    rows = schedule(docs, named, [0.25, 0.75], slots=150).collect()
    assert len(rows) == 1500
    mixed = [r for r in rows if r.in_mix]
    blocks = {(r.stream, r.block): r.slot for r in mixed}
    assert len(set(blocks.values())) == len(blocks)
    assert all((r.slot is None) == (not r.in_mix) for r in rows)
    assert {r.slot for r in mixed} == set(range(max(r.slot for r in mixed) + 1))
    assert abs(sum(r.stream == 0 for r in mixed) - 0.25 * len(mixed)) <= 11
    assert sorted(r.doc_id for r in keep_mixed(docs).collect()) == sorted(
        r.doc_id for r in schedule(docs, named, weights).collect() if r.in_mix
    )


def uneven(rare=3):
    """Two sources over the cap, some of all sizes below it, small ones, null and empty, texts of all lengths."""
    sources = ["hot"] * 400 + ["warm"] * 300 + [f"s{i % 12}" for i in range(200)] + [None] * 60 + [""] * 40
    sources += [f"rare{i}" for i in range(rare)]
    texts = [None, "", "é" * 50] + ["x" * (i * i % 900) for i in range(50)]
    return [(i, texts[i * 7 % len(texts)], "en", x) for i, x in enumerate(sources)]


@pytest.mark.parametrize("rare", [0, 1, 3])
def test_uneven_weights_match_sql(spark, tmp_path, rare):
    folder = folder_of(table(spark, uneven(rare)), tmp_path)
    df = op4_pfair_mix(spark, folder)
    columns, result = sql_of(folder)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows = sorted(map(tuple, df.select(*names).collect()), key=key)
    assert rows == sorted(result.fetchall(), key=key)
    streams = {r.stream for r in df.collect()}
    assert len(streams) >= 10
    assert {r.in_mix for r in df.collect()} == {True, False}


def sql_of(folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = db.execute(OP4_SQL)
    return sorted(c[0] for c in result.description), result


def test_own_shares_keep_every_row(spark):
    """No source reaches the cap, so every stream runs out at the same time and nothing falls out."""
    rows = [(i, "x" * (i % 700), "en", f"s{i % 9}") for i in range(900)] + [(5000, "y", "en", "rare")]
    docs = table(spark, rows)
    placed = schedule(docs, *capped_weights(docs)).collect()
    assert all(r.in_mix for r in placed) and len({r.stream for r in placed}) == 10
    assert keep_mixed(docs).count() == len(rows)


def test_odd_rows(spark):
    rows = [(1, None, "en", None), (1, None, "en", None), (None, "", "en", "a"), (2, "long " * 100_000, None, "a")]
    docs = table(spark, rows, "0 as SLOT")
    assert schedule(docs, *capped_weights(docs)).count() == 4
    assert keep_mixed(docs).columns == docs.columns
    none = docs.limit(0)
    assert schedule(none, *capped_weights(none)).count() == 0 and keep_mixed(none).count() == 0


def test_streams_without_rows_are_left_out(spark):
    docs = table(spark, [(i, "z" * 100, "en", "a") for i in range(50)])
    rows = schedule(docs, ["missing", "a"], [0.5, 0.3, 0.2]).collect()
    assert len(rows) == 50 and all(r.in_mix for r in rows)
    with pytest.raises(ValueError, match="weights above 0"):
        schedule(docs, ["a"], [0, 1])


@pytest.mark.parametrize("shares, rest", [((600, 400), 1), ((1000,), 1), ((330, 330, 340), 3)])
def test_a_tiny_rest_does_not_end_the_mix(spark, shares, rest):
    """Streams of some hundred blocks, and a rest of one row or a few."""
    rows = [(1000 * s + i, "x" * 1499, "en", f"s{s}") for s, n in enumerate(shares) for i in range(n)]
    docs = table(spark, rows + [(9000 + i, "y" * 1499, "en", None) for i in range(rest)])
    named, weights = capped_weights(docs)
    assert named == [f"s{i}" for i in range(len(shares))]
    rows = schedule(docs, named, weights, slots=sum(shares) + rest).collect()
    slots = {r.slot: r.stream for r in rows if r.in_mix}
    # The stream that lasts shortest at exact weights: nothing is lost but the slot it ends in.
    end = min(Fraction(n * sum(weights), w) for n, w in zip([*shares, rest], weights, strict=True))
    assert len(rows) == sum(shares) + rest and len(slots) >= end - 1
    for s, w in enumerate(weights):
        assert abs(sum(x == s for x in slots.values()) - end * Fraction(w, sum(weights))) < 1
