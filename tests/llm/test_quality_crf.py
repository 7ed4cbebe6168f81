import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm.columns import read
from tallyframe.llm.quality_crf import FEATURES, Crf, fit, joined, judge, keep_good, read_lines, spread, train

from tests.llm.helpers import DATA, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\n #é\x1c\x85\t漢", max_size=60))
def test_base_counts_match_brute_force(text):
    x = read_lines(text)
    assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(text)


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(0)
    for _ in range(20):
        model = Crf(rng.normal(size=len(FEATURES)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(7, len(FEATURES)))
        score = lambda ys: sum(y * (f @ model.weights) for y, f in zip(ys, x, strict=True)) + sum(
            model.pairs[a, b] for a, b in itertools.pairwise(ys)
        )
        best = max(itertools.product((0, 1), repeat=7), key=score)
        assert model.decode(x).tolist() == list(best)


def test_training_separates_two_kinds_of_lines():
    rng = np.random.default_rng(1)
    sides = [(rng.normal(2 * y - 1, 0.3, (9, len(FEATURES))), y) for y in (0, 1) for _ in range(20)]
    model = train(sides)
    assert all((model.decode(x) == y).all() for x, y in sides)
    assert train([s for s in sides if s[1]]) is None


def test_verdict_follows_held_out_labels(spark):
    docs, labels = read(spark, f"{DATA}/sf0.01", "documents"), read(spark, f"{DATA}/sf0.01", "labels")
    model = fit(docs, labels.where("doc_id % 2 = 0"))
    rows = judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert len(rows) > 100
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_joined_texts_change_their_label_where_they_are_joined(spark):
    """Texts of held-out good and bad documents in one; the share of content decides them."""
    docs, labels = read(spark, f"{DATA}/sf0.01", "documents"), read(spark, f"{DATA}/sf0.01", "labels")
    model = fit(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").orderBy("doc_id").select("text", "quality").collect()
    lines = lambda t: [x for x in t.split("\n") if x.split()]
    good, bad = ([lines(r.text)[:30] for r in held if r.quality == q and len(lines(r.text)) >= 5] for q in (1, 0))
    rows, borders, sides = [], [], []
    for i, (a, b) in enumerate(itertools.product(good[:12], bad[:8])):
        first, last = (a, b) if i % 2 else (b, a)
        rows.append((i, "\n".join(first + last)))
        borders.append(len(first))
        sides.append("CB" if i % 2 else "BC")
    found = {r.doc_id: r for r in judge(table(spark, rows), model).collect()}
    near = right = between = 0
    for i, (border, side) in enumerate(zip(borders, sides, strict=True)):
        r = found[i]
        truth = side[0] * border + side[1] * (len(r.line_labels) - border)
        wrong = [at for at, (x, y) in enumerate(zip(r.line_labels, truth, strict=True)) if x != y]
        near += all(border - 2 <= at < border + 2 for at in wrong)
        between += 0 < r.content_share < 1
        chars = [len("".join(x.split())) for x in lines(rows[i][1])]
        share = sum(c for c, x in zip(chars, r.line_labels, strict=True) if x == "C") / sum(chars)
        assert abs(share - r.content_share) < 1e-9
        right += r.kept == (not r.base_failed and share >= 0.5)
    assert right == len(rows)
    assert between > 0.9 * len(rows)
    assert near > 0.7 * len(rows)
    assert {r.kept for r in found.values() if 0 < r.content_share < 1} == {True, False}


def test_training_sequences():
    rng = np.random.default_rng(3)
    sides = [(rng.normal(size=(n, len(FEATURES))), y) for y in (0, 1) for n in (1, 5, 40)]
    made = joined(sides)
    assert len(made) == len(sides)
    for x, y in made:
        assert len(x) == len(y) and set(y) == {0, 1}
    x = np.arange(1000.0)[:, None]
    assert len(spread(x, 512)) == 512 and spread(x, 512)[-1] == 999 and len(spread(x[:512], 512)) == 512


def test_odd_rows_and_missing_labels(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    docs = table(spark, [(1, None), (2, ""), (3, " \n "), (4, long), (4, long), (None, "x y")], "true as KEPT")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = judge(docs, fit(docs, labels)).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in rows) == [
        (0, True, False), (0, True, False), (0, True, False), (2, True, False),
        (60_000, False, True), (60_000, False, True),
    ]
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 2
    assert judge(docs.limit(0), None).count() == 0
