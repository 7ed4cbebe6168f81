import numpy as np

from tallyframe.llm.columns import read
from tallyframe.llm.language_id import DIMENSIONS, fit, letter_vector, letters_of, op1_language_id, predict, sums

from tests.llm.helpers import DATA, table


def brute(text):
    letters = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    letters = " " + " ".join(letters.split()) + " " if letters.strip() else " "
    out = np.zeros(DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        x, y, z = (letter_vector(ord(v)).astype(int) for v in (a, b, c))
        out += np.roll(x, 2) * np.roll(y, 1) * z
    return out


def test_text_vectors_match_the_definition():
    texts = ["", "a", "Hello,  world!", "été 漢字かな 123 x", "İß Σ", "no\nlines" * 40]
    got = sums([letters_of(t) for t in texts])
    assert all((brute(t) == v).all() for t, v in zip(texts, got, strict=True))


def test_long_texts_count_whole():
    text = "abc déf " * 100_000
    (got,) = sums([letters_of(text)])
    (once, twice) = sums([letters_of("abc déf "), letters_of("abc déf abc déf ")])
    assert (got == once + (twice - once) * 99_999).all()


def test_held_out_accuracy(spark):
    sf_dir = f"{DATA}/sf0.01"
    rows = op1_language_id(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").collect()
    assert len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_odd_rows(spark):
    rows = [
        (1, "the cat and the dog", "en", "s"), (2, "der hund und die katze", "de", "s"), (3, None, "en", "s"),
        (4, "12 !", "de", "s"), (5, "und die der", None, "s"), (5, "und die der", None, "s"), (None, "the and", None, "s"),
    ]
    docs = table(spark, rows, "0 as SCORE")
    got = sorted((str(r.doc_id), r.lang_pred) for r in predict(docs, fit(docs)).collect())
    assert got == [("1", "en"), ("2", "de"), ("3", "und"), ("4", "und"), ("5", "de"), ("5", "de"), ("None", "en")]
    assert {r.lang_pred for r in predict(docs, fit(docs.limit(0))).collect()} == {"und"}
    assert predict(docs.limit(0), {}).count() == 0
