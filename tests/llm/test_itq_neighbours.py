"""Links and components against all pairs, recall at the threshold, and odd vectors."""

import numpy as np
import pytest

from tallyframe.llm.columns import read
from tallyframe.llm.itq_neighbours import COSINE, Quantiser, fit, neighbours, unit

from tests.llm.helpers import DATA


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as CID", "0 as label").repartition(2)


def brute(rows):
    """vec_id -> (links, smallest vec_id reachable), by comparing all pairs."""
    ids, vectors = zip(*rows, strict=True)
    x = unit(np.array(vectors, np.float32))
    linked = x @ x.T >= COSINE
    np.fill_diagonal(linked, False)
    reach = np.arange(len(ids))
    for _ in range(len(ids)):
        low = np.array([min(reach[i], *reach[linked[i]]) if linked[i].any() else reach[i] for i in range(len(ids))])
        if (low == reach).all():
            break
        reach = low
    ids = np.array(ids)
    return {i: (int(n), int(min(ids[reach == r]))) for i, n, r in zip(ids.tolist(), linked.sum(1), reach, strict=True)}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def partners(rng, x, cosine):
    """For each row of x a unit vector at this cosine."""
    aside = rng.standard_normal(x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine * cosine) * unit(aside)


def groups(rng, dims, spread, alone):
    """Vectors in groups around some centres, copies of some, and vectors alone, in random order."""
    centres = unit(rng.standard_normal((8, dims)))
    rows = [partners(rng, np.repeat(c[None], 40, 0), spread) * rng.uniform(0.5, 2) for c in centres]
    rows = np.concatenate([*rows, rows[0][:7], rng.standard_normal((alone, dims))])
    return list(enumerate(rows[rng.permutation(len(rows))].tolist()))


@pytest.mark.parametrize("settings", [{}, {"small": 1, "block": 7}], ids=["usual", "blocks"])
def test_near_copies_match_all_pairs(spark, settings):
    rows = groups(np.random.default_rng(1), 32, 0.99, 300)
    df = neighbours(table(spark, rows), **settings)
    want = brute(rows)
    assert got(df) == want
    assert {r.vec_id for r in df.collect() if r.kept} == {c for _, c in want.values()}


def test_recall_of_pairs_at_the_threshold(spark):
    """One pair for each of 1500 vectors, at cosines from 0.95 to 0.955, in two shapes of data."""
    rng = np.random.default_rng(4)
    for shape in (np.ones(48), np.geomspace(4, 0.3, 48)):
        x = unit(rng.standard_normal((1500, 48)) * shape + 0.2)
        y = partners(rng, x, rng.uniform(0.9502, 0.955, (1500, 1)))
        rows = list(enumerate(np.concatenate([x, y]).tolist()))
        want, found = brute(rows), got(neighbours(table(spark, rows, "double")))
        links = sum(n for n, _ in want.values())
        assert links >= 3000
        assert all(found[i][0] <= want[i][0] for i in want)
        assert sum(n for n, _ in found.values()) >= 0.93 * links


def test_given_table_matches_all_pairs(spark):
    vectors = read(spark, f"{DATA}/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    x = np.array([v for _, v in rows], float)
    rng = np.random.default_rng(7)
    rows += list(enumerate(partners(rng, unit(x[:200]), 0.97).tolist(), 10_000))
    want, found = brute(rows), got(neighbours(table(spark, rows)))
    assert sum(n for n, _ in found.values()) >= 0.95 * sum(n for n, _ in want.values()) > 0
    assert all(found[i][0] <= want[i][0] for i in want)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (None, [10.0, 20.0]), (11, [-1.0, -2.0]),
        (12, [0.0, 1.0, 0.0]), (13, [-0.0, 1.0]), (14, [0.0, 5.0, 0.1]), (None, [3.0, -1.0]), (16, [1e300, 2e300]),
    ]
    found = sorted(map(tuple, neighbours(table(spark, rows, "double")).collect()), key=str)
    alike = [(i, 5, 7, i == 7) for i in (7, 8, 8, 9, None, 16)]
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 11)] + alike
    want += [(i, 2, 12, i == 12) for i in (12, 13, 14)] + [(None, 0, None, True)]
    assert found == sorted(want, key=str)
    assert neighbours(table(spark, rows, "double").limit(0)).count() == 0
    assert neighbours(table(spark, [(1, None)])).collect()[0].kept


def test_one_vector_of_most_rows(spark):
    rows = [(i, [0.5, 0.5, -1.0]) for i in range(200)] + [(1000, [0.5, 0.5, -1.001]), (1001, [1.0, 0.0, 0.0])]
    found = got(neighbours(table(spark, rows)))
    assert found[0] == (200, 0) and found[199] == (200, 0) and found[1000] == (200, 0) and found[1001] == (0, 1001)


def test_the_rotation_lessens_the_error_of_the_signs():
    rng = np.random.default_rng(2)
    x = unit(rng.standard_normal((3000, 16)) * np.geomspace(3, 0.2, 16))
    loss = lambda q: [np.square(np.sign((x - q.mean) @ t) - (x - q.mean) @ t).sum() for t in q.turns]
    start, learnt = fit(x, 3000, rounds=0), fit(x, 3000, rounds=40)
    assert max(loss(learnt)) < min(loss(start))
    for turn in learnt.turns:
        assert np.allclose(turn.T @ turn, np.eye(16))
    share = np.concatenate([s.mean(0) for s in learnt.signs(x)])
    assert 0.3 < share.min() and share.max() < 0.7
    assert isinstance(learnt, Quantiser) and learnt.tables <= len(learnt.turns) * learnt.per_code
