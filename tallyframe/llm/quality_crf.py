"""Quality rules by line labelling with a linear-chain conditional random field.

Every text is read as its sequence of lines. A conditional random field with two
labels (content, boilerplate), trained here, scores each line by its features and
each pair of neighbours by a transition weight; Viterbi decoding picks the best
sequence. The share of word characters in content lines decides retention, after the
base rules (too few words, too many repeated three-word windows).

Training reads at most ``sample`` labelled documents (parameter, 3000 by default: the
first in hash order of doc_id among those with a quality label) and at most ``lines`` lines
of each (parameter, 512 by default, in runs spread over the text). The lines of a good
document count as content and those of a bad one as boilerplate; and because labels never
change within such a document, as many sequences are joined from runs of lines of good and
bad ones, in alternation, where every change is known. Nothing but the features of lines
reaches the driver. Without labels of both kinds there is no model, and every line is
content. Decoding covers whole texts of all rows.

Defined results: a null or empty text has no words and fails the base rules; repeated
rows and ids are judged one by one; extra columns pass through.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.columns import appended, read

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
SAMPLE = 3000
LINES = 512
#: Lines of one training sequence; longer documents give several.
WINDOW = 64
#: Lines of a run in a joined sequence at most, and its runs at most.
RUN, RUNS = 12, 5

LETTER, UPPER, DIGIT, SYMBOL, SPACE, BANG = 1, 2, 4, 8, 16, 32
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "bias", "log_chars", "letters", "upper", "digits", "symbols", "bangs",
    "word_length", "repeated_line", "distinct_words", "ends_sentence", "short",
)
CONTENT = 1

BASE_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
)


@functools.cache
def _classes() -> np.ndarray:
    """The class bits of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            out[code] = LETTER | UPPER * (kind in ("Lu", "Lt"))
        elif kind == "Nd":
            out[code] = DIGIT
    for c in SYMBOLS:
        out[ord(c)] |= SYMBOL
    for code in (32, *range(9, 14)):
        out[code] = SPACE
    out[ord("!")] |= BANG
    return out


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words) - 2
    if n < 2 or len(set(zip(words, words[1:], words[2:], strict=False))) == n:
        return 0
    numbers: dict[tuple, int] = {}
    ids = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for w in zip(words, words[1:], words[2:], strict=False)),
        np.int64,
        n,
    )
    again = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


@dataclass
class Lines:
    """Counts of a text, and the features and word characters of its lines with a word."""

    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    features: np.ndarray = None
    weights: np.ndarray = None

    @property
    def base_failed(self) -> bool:
        return (
            self.n_words < MIN_WORDS
            or 100 * self.n_repeat_words > MAX_REPEATED_PERCENT * self.n_words
        )


def read_lines(text: str | None) -> Lines:
    words = text.encode().split() if text else []
    if not words:
        n_symbols = sum(text.count(c) for c in SYMBOLS) if text else 0
        return Lines(n_symbols=n_symbols, features=np.zeros((0, len(FEATURES))), weights=np.zeros(0))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = _classes()[codes]
    ends = np.append(np.flatnonzero(codes == 10), len(codes))
    starts = np.append(0, ends[:-1] + 1)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[ends] - total[starts]

    solid = (kinds & SPACE) == 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    chars, n_words = per_line(solid), per_line(first)
    symbols = per_line((kinds & SYMBOL) != 0)
    lines = text.split("\n")
    seen: set[str] = set()
    repeated = np.zeros(len(lines), bool)
    distinct = np.zeros(len(lines))
    last = np.zeros(len(lines), bool)
    for i in np.flatnonzero(chars).tolist():
        line = lines[i]
        repeated[i] = line in seen
        seen.add(line)
        distinct[i] = len(set(line.split())) / n_words[i]
        last[i] = line.rstrip()[-1:] in (".", "?", ":", ";", "。", "؟")
    there = chars > 0
    size = np.maximum(chars, 1)
    letters = per_line((kinds & LETTER) != 0)
    columns = [
        np.ones(len(lines)),
        np.log1p(chars) / 5,
        letters / size,
        per_line((kinds & UPPER) != 0) / np.maximum(letters, 1),
        per_line((kinds & DIGIT) != 0) / size,
        np.minimum(1, 4 * symbols / size),
        np.minimum(1, 4 * per_line((kinds & BANG) != 0) / size),
        np.minimum(2, size / np.maximum(n_words, 1) / 10),
        repeated,
        distinct,
        last,
        n_words < 4,
    ]
    return Lines(
        n_words=len(words),
        word_chars=int(chars.sum()),
        n_symbols=int(symbols.sum()),
        n_dup_lines=int(repeated.sum()),
        n_repeat_words=repeated_window_words(words),
        features=np.stack(columns, 1)[there].astype(float),
        weights=chars[there].astype(float),
    )


@dataclass(frozen=True)
class Crf:
    """Weights of the content label against boilerplate, and of label pairs."""

    weights: np.ndarray
    pairs: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The best label sequence by the Viterbi algorithm; 1 is content."""
        n = len(features)
        if n == 0:
            return np.zeros(0, np.int64)
        score = (features @ self.weights).tolist()
        (bb, bc), (cb, cc) = self.pairs.tolist()
        boiler, content = 0.0, score[0]
        back = []
        for s in score[1:]:
            to_b, to_c = (boiler + bb < content + cb), (boiler + bc < content + cc)
            back.append((to_b, to_c))
            boiler, content = (
                content + cb if to_b else boiler + bb,
                (content + cc if to_c else boiler + bc) + s,
            )
        label = int(content >= boiler)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])


def spread(x: np.ndarray, lines: int) -> np.ndarray:
    """The rows of x, or ``lines`` of them in runs of WINDOW at equal distances."""
    if len(x) <= lines:
        return x
    starts = np.linspace(0, len(x) - WINDOW, max(1, lines // WINDOW)).astype(int)
    return np.concatenate([x[i : i + WINDOW] for i in starts])


def joined(sequences: list[tuple[np.ndarray, int]], seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """As many sequences of runs that change between the labels, with the label of each line."""
    rng = np.random.default_rng(seed)
    of = [[x for x, y in sequences if y == label and len(x)] for label in (0, 1)]
    out = []
    for _ in range(len(sequences) if all(of) else 0):
        first = int(rng.integers(2))
        xs, ys = [], []
        for turn in range(int(rng.integers(2, RUNS + 1))):
            label = (first + turn) % 2
            whole = of[label][rng.integers(len(of[label]))]
            n = min(len(whole), int(rng.integers(1, RUN + 1)))
            at = int(rng.integers(len(whole) - n + 1))
            xs.append(whole[at : at + n])
            ys.append(np.full(n, label))
        out.append((np.concatenate(xs), np.concatenate(ys)))
    return out


@dataclass
class Padded:
    """Sequences of like length side by side, to the longest of them."""

    xs: np.ndarray
    ys: np.ndarray
    there: np.ndarray
    weight: np.ndarray

    def gradient(self, w: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood, by forward-backward: for the features and for the pairs."""
        n, length, _ = self.xs.shape
        emit = np.stack([np.zeros((n, length)), self.xs @ w], 2)
        alpha, beta = np.zeros((length, n, 2)), np.zeros((length, n, 2))
        alpha[0] = emit[:, 0]
        for t in range(1, length):
            nxt = np.logaddexp(alpha[t - 1][:, :1] + pairs[0], alpha[t - 1][:, 1:] + pairs[1]) + emit[:, t]
            alpha[t] = np.where(self.there[:, t, None], nxt, alpha[t - 1])
        for t in range(length - 2, -1, -1):
            after = emit[:, t + 1] + beta[t + 1]
            prev = np.logaddexp(after[:, :1] + pairs[:, 0], after[:, 1:] + pairs[:, 1])
            beta[t] = np.where(self.there[:, t + 1, None], prev, 0)
        total = np.logaddexp(alpha[-1][:, 0], alpha[-1][:, 1])
        share = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total).T
        features = np.einsum("nt,ntf->f", (self.ys - share) * self.weight, self.xs)
        both = np.zeros((2, 2))
        for t in range(1, length):
            joint = alpha[t - 1][:, :, None] + pairs + (emit[:, t] + beta[t])[:, None, :]
            both -= np.einsum("nab,n->ab", np.exp(joint - total[:, None, None]), self.weight[:, t])
            np.add.at(both, (self.ys[:, t - 1], self.ys[:, t]), self.weight[:, t])
        return features, both


def _padded(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[Padded]:
    # Both labels weigh the same in total, whatever their share of the lines.
    lines = np.bincount(np.concatenate([y for _, y in parts]), minlength=2)
    parts = sorted(parts, key=lambda p: len(p[0]))
    out = []
    for longest in (4, 8, 16, 32, WINDOW):
        group = [p for p in parts if longest // 2 < len(p[0]) <= longest or len(p[0]) <= longest == 4]
        if not group:
            continue
        shape = len(group), max(len(x) for x, _ in group)
        made = Padded(np.zeros((*shape, len(FEATURES))), np.zeros(shape, int), np.zeros(shape, bool), np.zeros(shape))
        for i, (x, y) in enumerate(group):
            made.xs[i, : len(x)], made.ys[i, : len(x)], made.there[i, : len(x)] = x, y, True
            made.weight[i, : len(x)] = 0.5 / lines[y].mean()
        # One weight for each sequence, so that the likelihood is a sum over sequences.
        made.weight = made.there * (made.weight.sum(1) / made.there.sum(1))[:, None]
        out.append(made)
    return out


def train(
    sequences: list[tuple[np.ndarray, int]], rounds: int = 300, decay: float = 1e-3, tolerance: float = 2e-3
) -> Crf | None:
    """Maximum likelihood by forward-backward and Adam, until the gradient is small; None without both labels."""
    if {y for _, y in sequences} != {0, 1}:
        return None
    labelled = [(x, np.full(len(x), y)) for x, y in sequences] + joined(sequences)
    groups = _padded([(x[i : i + WINDOW], y[i : i + WINDOW]) for x, y in labelled for i in range(0, len(x), WINDOW)])
    width = len(FEATURES)
    theta = np.zeros(width + 4)
    moment, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = -decay * theta
        for group in groups:
            features, both = group.gradient(theta[:width], theta[width:].reshape(2, 2))
            grad[:width] += features
            grad[width:] += both.ravel()
        if np.abs(grad).max() < tolerance:
            break
        moment = 0.9 * moment + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta += 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Crf(theta[:width], theta[width:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Crf | None:
    """A model from at most ``sample`` labelled documents; only features of at most ``lines`` lines of each are collected."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")

    def features(batches):
        for batch in batches:
            for text, label in zip(
                batch.column("text").to_pylist(), batch.column("quality").to_pylist(), strict=True
            ):
                x = spread(read_lines(text).features, lines)
                if len(x):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x.astype(np.float32).tobytes()]), pa.array([int(label)], pa.int32())],
                        names=["x", "y"],
                    )

    # Rows that repeat an id are as many as they are; the first in order of their features count.
    found = texts.mapInArrow(features, "x binary, y int").orderBy("y", "x").limit(2 * sample).collect()
    return train(
        [(np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)).astype(float), r.y) for r in found]
    )


def judge(docs: DataFrame, model: Crf | None) -> DataFrame:
    """``docs`` with the counts, base_failed, line_labels, content_share and kept.

    ``line_labels`` holds one C (content) or B (boilerplate) for each line with a word.
    """

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out: dict[str, list] = {c.split()[0]: [] for c in BASE_DDL.split(", ")}
        out |= {"base_failed": [], "line_labels": [], "content_share": [], "kept": []}
        for scalar in batch.column("text"):
            lines = read_lines(scalar.as_py())
            for name in list(out)[:5]:
                out[name].append(getattr(lines, name))
            label = model.decode(lines.features) if model else np.ones(len(lines.features), int)
            total = lines.weights.sum()
            share = float(lines.weights[label == CONTENT].sum() / total) if total else 0.0
            out["base_failed"].append(lines.base_failed)
            out["line_labels"].append("".join("BC"[v] for v in label))
            out["content_share"].append(share)
            out["kept"].append(not lines.base_failed and share >= MIN_CONTENT_SHARE)
        return {k: pa.array(v) for k, v in out.items()} | {
            k: pa.array(out[k], pa.int64()) for k in list(out)[:5]
        } | {"line_labels": pa.array(out["line_labels"], pa.string())}

    return appended(
        docs, f"{BASE_DDL}, base_failed boolean, line_labels string, content_share double, kept boolean", make
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only."""
    verdict = judge(docs.select(F.struct("*").alias("row"), "text"), fit(docs, labels))
    return verdict.where("kept").select("row.*")


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return judge(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "content_share",
    )
