"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones (``DIMENSIONS`` long, drawn from
its code point). A three-letter sequence is the product of its letters' vectors, each
rotated by its place (binding); a text is the sum of its sequences (bundling), and a
language is the sum of its training texts. The language whose vector has the largest
cosine with a text's is predicted; the cosine, not below 0, is the score.

Texts are lower-cased; whatever is not a letter counts as a space, and spaces in a row as
one. The sum over a text is taken as counts of its distinct sequences times their
vectors, for a block of texts at once. Long texts are taken in spans that overlap by two
letters, so that memory is bounded; all of every text counts.

Training reads text and lang of all rows that are not held out and have a lang; each task
sums its texts into one vector per language before the shuffle. The model on the driver
has one vector per language (the number of languages is taken to be small).

Defined results: ``und`` with score 0 for a null text, one without letters, or without
any training language; ties go to the language first in order; repeated rows count as
often as they are there; a null doc_id is hashed as an empty string; extra columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.columns import read

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
HELD_OUT_OF = 5
#: Letters of one span of a text, and of the texts that are summed at once.
SPAN = 1 << 18
#: Letter vectors that a worker process keeps.
KEPT_LETTERS = 20_000


@functools.lru_cache(KEPT_LETTERS)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([code, 2024]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


@functools.lru_cache(KEPT_LETTERS)
def _is_letter(code: int) -> bool:
    return chr(code).isalpha()


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with 32 for each run of other characters, at both ends too."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, inverse = _distinct(codes)
    codes = np.where(np.array([_is_letter(c) for c in kinds.tolist()])[inverse], codes, 32)
    return codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and each value's place among them, without a sort where codes are low."""
    top = int(codes.max()) + 1
    if top > 1 << 21:
        return np.unique(codes, return_inverse=True)
    there = np.zeros(top, bool)
    there[codes] = True
    kinds = np.flatnonzero(there)
    place = np.zeros(top, np.int64)
    place[kinds] = np.arange(len(kinds))
    return kinds, place[codes]


def sums(texts: list[np.ndarray]) -> np.ndarray:
    """The bundled vector of each text (letters as from ``letters_of``), as doubles."""
    out = np.zeros((len(texts), DIMENSIONS))
    spans, held = [], 0
    for i, letters in enumerate(texts):
        for start in range(0, max(1, len(letters) - GRAM + 1), SPAN):
            part = letters[start : start + SPAN + GRAM - 1]
            spans.append((i, part))
            held += len(part)
            if held >= SPAN:
                _add(out, spans)
                spans, held = [], 0
    if spans:
        _add(out, spans)
    return out


def _add(out: np.ndarray, spans: list[tuple[int, np.ndarray]]) -> None:
    """Adds the vectors of the spans to the rows of their texts."""
    spans = [(i, x) for i, x in spans if len(x) >= GRAM]
    if not spans:
        return
    joined = np.concatenate([x for _, x in spans])
    lengths = np.array([len(x) for _, x in spans])
    row = np.repeat(np.arange(len(spans)), lengths)
    kinds, at = _distinct(joined)
    n = len(kinds)
    gram = at[:-2] * (n * n) + at[1:-1] * n + at[2:]
    same = row[:-2] == row[2:]  # no sequence crosses from one text into the next
    gram, row = gram[same], row[:-2][same]
    grams, place = _distinct(gram)
    vectors = np.stack([letter_vector(c) for c in kinds.tolist()])
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    order = np.array([i for i, _ in spans])
    for block in range(0, len(grams), 4096):  # bounds the dense table of counts
        own = grams[block : block + 4096]
        bound = first[own // (n * n)] * second[own // n % n] * vectors[own % n]
        here = (place >= block) & (place < block + len(own))
        cell = row[here] * len(own) + place[here] - block
        counts = np.bincount(cell, minlength=len(spans) * len(own)).reshape(len(spans), len(own))
        np.add.at(out, order, (counts.astype(np.float32) @ bound.astype(np.float32)).astype(float))


def held_out() -> Column:
    """Whether a document is kept out of training: crc32 of its doc_id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % HELD_OUT_OF == 0


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """One vector per language from (text, lang); sums are whole numbers, so their order does not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            groups: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                groups.setdefault(lang, []).append(letters_of(text.as_py()))
            for lang, texts in groups.items():
                # A class needs one vector: its texts are summed as if they were one.
                vector = np.zeros((1, DIMENSIONS))
                spans, held = [], 0
                for letters in texts:
                    for start in range(0, max(1, len(letters) - GRAM + 1), SPAN):
                        spans.append((0, letters[start : start + SPAN + GRAM - 1]))
                        held += len(spans[-1][1])
                        if held >= SPAN:
                            _add_to_one(vector, spans)
                            spans, held = [], 0
                _add_to_one(vector, spans)
                total[lang] = total.get(lang, 0) + vector[0]
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * DIMENSIONS),
                    pa.array(range(DIMENSIONS), pa.int32()),
                    pa.array(np.rint(vector).astype(np.int64)),
                ],
                names=["lang", "place", "value"],
            )

    rows = (
        labelled.where("text is not null and lang is not null")
        .select("text", "lang")
        .mapInArrow(run, "lang string, place int, value long")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    model: dict[str, np.ndarray] = {}
    for r in rows:
        model.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["place"]] = r["value"]
    return dict(sorted(model.items()))


def _add_to_one(vector: np.ndarray, spans: list[tuple[int, np.ndarray]]) -> None:
    """Adds all spans to one vector: sequences are counted over all of them."""
    spans = [x for _, x in spans if len(x) >= GRAM]
    if not spans:
        return
    joined = np.concatenate(spans)
    row = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
    kinds, at = _distinct(joined)
    n = len(kinds)
    gram = (at[:-2] * (n * n) + at[1:-1] * n + at[2:])[row[:-2] == row[2:]]
    grams, place = _distinct(gram)
    counts = np.bincount(place, minlength=len(grams)).astype(float)
    vectors = np.stack([letter_vector(c) for c in kinds.tolist()])
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    for block in range(0, len(grams), 4096):
        own = grams[block : block + 4096]
        bound = first[own // (n * n)] * second[own // n % n] * vectors[own % n]
        vector[0] += counts[block : block + 4096] @ bound.astype(float)


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    langs = list(model)
    profiles = np.stack([v / max(np.linalg.norm(v), 1e-9) for v in model.values()]) if langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [letters_of(t.as_py() or "") for t in batch.column("text")]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if langs:
                for start in range(0, len(texts), 256):
                    part = texts[start : start + 256]
                    vectors = sums(part)
                    norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
                    cosine = vectors @ profiles.T / norm[:, None]
                    best = cosine.argmax(1)
                    for i, letters in enumerate(part):
                        if (letters != 32).any():
                            lang[start + i] = langs[best[i]]
                            score[start + i] = min(1.0, max(0.0, cosine[i, best[i]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~held_out())))
