"""Near duplicates by the Jaccard similarity of word shingles, with PartEnum signatures.

Two sets of sizes a and b with 100 * |intersection| >= 75 * |union| differ in at most
(a + b) / 7 elements. Sizes are cut into bands of ratio 4/3; a pair belongs to the band of
its smaller set, so a set takes part in its own band and, as the larger one, in the band
below. With H the most differences of a band, the domain of shingles is cut on two levels:

- n1 first-level partitions, n1 = floor(H / (k2 + 1)) + g. Of these, at least g hold k2
  differences or fewer (they are good).
- n2 second-level partitions in each. Every subset of n2 - k2 of them is enumerated, and a
  signature is such a subset together with the set's elements in it. In a good partition
  some subset holds no difference, so similar sets share its signature.

A subset without elements says nothing and is no signature. It is all that two similar sets
share in a good partition only if both occupy k2 second-level partitions or fewer there;
such a partition is low, and each g low partitions of a set make one more signature. So
every similar pair shares a signature. For each band, k2, n2 and g are those with which
unrelated sets share the fewest, within a bound on the number of signatures (``scheme``).

Sharing signatures proposes a pair; the sets themselves are compared before two
documents are linked. Not all pairs of a signature are compared:

1. Copies (equal sets) are one class. A similar partner holds 75 % of a class's elements
   or more; a class of which fewer elements occur in other classes has none and goes
   before it has signatures. That rules out what shares a passage, however common,
   without looking at pairs. An element of many classes is settled on the map side and
   reaches its shuffle as one row for each task.
2. Each signature ties its classes to a leader, on the map side first, in the same way.
   Classes that share no signature are done.
3. A signature is led by its class with most signatures, and each class joins the leader
   it shares most of them with, if these are two and a fiftieth of its size: classes tied that way
   are a family, such as the copies of one text with words changed. Each is compared with
   its leader. What that links into one group needs no more; the rest of a family is
   compared with all of it, as products of 0/1 matrices over blocks of bounded size (a
   large family is cut into blocks, and each pair of blocks is a task); a block returns
   one edge for each class at most.
4. Across families, a class shares no more elements with another one than occur in classes
   of other families. That number, counted like the one of step 1, bounds the size of a
   similar partner; where it leaves none, the class goes.
5. The classes that are left are compared in each signature, in one task, by these bounds
   and by coarse sketches (numbers of elements in parts of the domain, which differ by no
   more than the sets do). Only pairs that both leave become rows; fine sketches are compared
   for these, and then, where they are near enough, the sets.
6. A signature with too many pairs for one task is not compared that way. Its classes are
   split by the signatures of a further, differently seeded partition of the domain, and
   step 5 repeats inside. After ``LEVELS`` splits all signatures are compared.

Links are closed into components by large star and small star rounds.

Parameters: five words, 75 percent. Shingles are 64-bit hashes. A class is a 64-bit
fingerprint of its set; a second fingerprint detects two sets of one class, and the join
then runs anew with another seed (``SEEDS`` of them; if all clash, it raises).

Defined results: a text of fewer than five words has its whole sequence of words as the
one shingle; a null or empty text has none and links with nothing (its component is its
own doc_id); rows that repeat an id or a text share a component if their sets are equal;
a component of null ids only has a null component_id; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.columns import LOWER_ASCII, read
from tallyframe.llm.scratch import stored

WORDS = 5
PERCENT = 75
#: Pairs across families for each class of a signature, up to which one task compares their sketches.
FEW = 2048
#: Splits of large signatures, and classes and bytes of a block of a family. Results do not depend on them.
LEVELS = 6
#: The share of its size (one in TIE) that a class shares with its leader. Nor on this.
TIE = 50
#: Parts of the domain in a sketch.
SKETCH = 128
#: Seeds for classes.
SEEDS = 8
BLOCK_CLASSES = 1000
BLOCK_BYTES = 16 << 20

# Hashing

STEP = np.uint64(0x9E3779B97F4A7C15)
MULTIPLY = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + STEP * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * MULTIPLY[0]
        x = (x ^ (x >> np.uint64(27))) * MULTIPLY[1]
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    parts = text.encode().translate(LOWER_ASCII).split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(parts))
    out = hashes[: len(parts) - n + 1].copy()
    for i in range(1, n):  # word hashes are random, so their weighted sum is
        out *= STEP
        out += hashes[i : i + len(out)]
    return np.unique(mix(out, 0 if n == words else 100 + n))


def class_of(elements: np.ndarray, seed: int) -> tuple[int, int]:
    """Two fingerprints of a set."""
    total = elements.sum(dtype=np.uint64) if seed == 0 else mix(elements, 1000 + seed).sum(dtype=np.uint64)
    prints = np.array([total, np.bitwise_xor.reduce(elements)], np.uint64) + np.uint64(len(elements))
    first, second = mix(prints, seed).view(np.int64).tolist()
    return first, second


# Signatures


def band_starts() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(-(-out[-1] * 4 // 3) if out[-1] > 2 else out[-1] + 1)
    return out


STARTS = band_starts()


def band_of(size: int) -> int:
    return int(np.searchsorted(STARTS, size, side="right")) - 1


def most_differences(band: int) -> int:
    """The most elements in which two similar sets differ, the smaller of them in this band."""
    small = STARTS[band + 1] - 1
    return (small + small * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT)


def roles(size: int) -> list[int]:
    """The bands in which a set of this size takes part."""
    own = band_of(size)
    below = STARTS[own] - 1  # the largest size of the band below
    return [own, own - 1] if own and below * 100 >= PERCENT * size else [own]


@dataclass(frozen=True)
class Scheme:
    """How a band is partitioned: n1 x n2 partitions, subsets of n2 - k2, and g good partitions at least."""

    n1: int
    n2: int
    k2: int
    g: int

    @functools.cached_property
    def subsets(self) -> np.ndarray:
        """One column of 0 and 1 for each subset of n2 - k2 second-level partitions."""
        chosen = list(itertools.combinations(range(self.n2), self.n2 - self.k2))
        out = np.zeros((self.n2, len(chosen)), np.uint64)
        for column, rows in enumerate(chosen):
            out[list(rows), column] = 1
        return out


#: Signatures of a set of the least size of its band, at most so many for each element, and besides.
PER_ELEMENT, BESIDES = 1.0, 40


@functools.cache
def scheme(band: int) -> Scheme | None:
    """The scheme of a band by which unrelated sets share the fewest signatures; None if no two different sets are similar."""
    size, most = STARTS[band], most_differences(band)
    if not most:
        return None
    best = None
    for k2, extra, g in itertools.product(range(min(most, 6) + 1), range(1, 6), range(1, 5)):
        n1, n2 = most // (k2 + 1) + g, k2 + extra
        subsets = math.comb(n2, k2)
        there = 1 - math.exp(-size / n1 / n2)  # a second-level partition is occupied
        low = sum(math.comb(n2, j) * there**j * (1 - there) ** (n2 - j) for j in range(k2 + 1)) if n2 > k2 else 1
        lows = (n1 * low) ** g / math.factorial(g)
        number = n1 * subsets + lows
        # Sets with a third of their elements in common differ in 4/3 of the size of a set.
        held = size / n1 * extra / n2
        # A signature of low partitions has company among all sets of the band.
        shared = n1 * subsets * math.exp(-held * 4 / 3) + lows
        if number <= PER_ELEMENT * size + BESIDES and (best is None or shared < best[0]):
            best = (shared, Scheme(n1, n2, k2, g))
    return best[1]


def signatures(elements: np.ndarray, level: int = 0) -> np.ndarray:
    """All signatures of a set, as hashes."""
    out = [np.zeros(0, np.uint64)]
    spread = mix(elements, 10 + level) if level else elements
    with np.errstate(over="ignore"):
        for band in roles(len(elements)):
            plan = scheme(band)
            if plan is None:
                continue
            parts = plan.n1 * plan.n2
            part = (spread % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            first, _ = _runs(part[order])
            content = np.zeros(parts, np.uint64)
            content[part[order][first]] = mix(np.add.reduceat(elements[order], first), 2)
            content = content.reshape(plan.n1, plan.n2)
            occupied = content != 0
            held = content @ plan.subsets
            filled = (occupied.astype(np.uint8) @ plan.subsets.astype(np.uint8)) > 0
            tag = MULTIPLY[1] * np.uint64((band << 8) + level)
            number = np.arange(held.size, dtype=np.uint64).reshape(held.shape) * MULTIPLY[0]
            out.append(mix((held + number + tag)[filled], 3))
            low = np.flatnonzero(occupied.sum(1) <= plan.k2)
            if len(low) >= plan.g:
                named = mix(low.astype(np.uint64), 8)
                chosen = np.array(list(itertools.combinations(range(len(low)), plan.g)))
                out.append(mix(named[chosen].sum(1, dtype=np.uint64) + tag, 4))
    return np.concatenate(out)


# Rows of packed signatures: for one bucket, the classes, how many signatures each has, the
# signatures' low five bytes. With kind EDGES they are edges that a task has found by itself.
# Elements are packed in the same form; then COUNTS are numbers of elements of classes that a
# task has found in company, and KNOWN are elements that it has found in two classes; in rows of
# kind LABELLED, the labels of the classes follow them.

PACKED = "bucket int, kind int, part int, classes binary, counts binary, signatures binary"
PACKED_SCHEMA = pa.schema(
    [(n, pa.binary() if k == "binary" else pa.int32()) for n, k in (x.split() for x in PACKED.split(", "))]
)
OPEN, EDGES, COUNTS, KNOWN, LABELLED = range(5)
LOW_BITS = 40
#: Signatures that a task holds before it packs them, and those of a bucket on average.
HELD = 250_000
BUCKET = 1 << 21


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return first, np.diff(np.append(first, len(keys)))


def _edges_within(sig: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where rows need not go on, and the edges (signature, class, leader) that stand for them.

    The smallest class of a signature leads it; its first row goes on.
    """
    order = np.argsort(sig)
    first, lengths = _runs(sig[order])
    many = np.repeat(lengths > 1, lengths)
    at = order[many]
    at = at[np.lexsort((cls[at], sig[at]))]
    s, c = sig[at], cls[at]
    first, lengths = _runs(s)
    leader = np.repeat(c[first], lengths)
    done = np.ones(len(at), bool)
    done[first] = False
    edge = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))[: len(s)] & (c != leader)
    return at[done], s[edge], c[edge], leader[edge]


def _pack(sig: np.ndarray, cls: np.ndarray, buckets: int) -> Iterator[tuple]:
    done, *edges = _edges_within(sig, cls)
    yield from _pack_edges(*edges, buckets)
    stay = np.ones(len(sig), bool)
    stay[done] = False
    yield from _pack_open(sig[stay], cls[stay], buckets)


def _low(sig: np.ndarray) -> bytes:
    return sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8].tobytes()


def _pack_open(
    sig: np.ndarray, cls: np.ndarray, buckets: int, part: int = 0, kind: int = OPEN, label: np.ndarray | None = None
) -> Iterator[tuple]:
    bucket = (sig >> np.uint64(LOW_BITS)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
    sig, cls, bucket = sig[order], cls[order], bucket[order]
    label = None if label is None else label[order]
    for start, n in zip(*(x.tolist() for x in _runs(bucket)), strict=True):
        own = cls[start : start + n]
        first, counts = _runs(own)
        low = _low(sig[start : start + n])
        classes = own[first].tobytes() + (b"" if label is None else label[start : start + n][first].tobytes())
        yield int(bucket[start]), kind, part, classes, counts.astype(np.int32).tobytes(), low


def _pack_edges(sig, cls, leader, buckets) -> Iterator[tuple]:
    bucket = ((sig >> np.uint64(LOW_BITS)) % np.uint64(buckets)).astype(np.int64)
    low = (sig & np.uint64((1 << LOW_BITS) - 1)).astype(np.int64)
    spread = (mix(cls.view(np.uint64), 5) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(spread, kind="stable")
    run = spread[order]
    full = (bucket << LOW_BITS) + low
    for start, n in zip(*(x.tolist() for x in _runs(run)), strict=True):
        at = order[start : start + n]
        yield int(run[start]), EDGES, 0, cls[at].tobytes(), leader[at].tobytes(), full[at].tobytes()


def _packed_batch(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(PACKED_SCHEMA)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, PACKED_SCHEMA, strict=True)], schema=PACKED_SCHEMA
    )


def _packs(
    rows: Iterator[tuple[int, np.ndarray]], pack: Callable[[np.ndarray, np.ndarray], Iterator[tuple]]
) -> Iterator[pa.RecordBatch]:
    """Batches of packed rows from (class, its signatures or elements)."""
    sigs, classes, held = [], [], 0
    for cid, own in rows:
        sigs.append(own)
        classes.append(np.full(len(own), cid, np.int64))
        held += len(own)
        if held > HELD:
            yield _packed_batch(pack(np.concatenate(sigs), np.concatenate(classes)))
            sigs, classes, held = [], [], 0
    if held:
        yield _packed_batch(pack(np.concatenate(sigs), np.concatenate(classes)))


def _emit(sets: DataFrame, level: int, buckets: int) -> DataFrame:
    """Packed signatures of (cid, elements) or, from level 1 on, of (cid, elements, inside)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            inside = batch.column("inside").to_pylist() if level else [None] * len(batch)
            cids = batch.column("cid").to_pylist()
            for cid, data, within in zip(cids, batch.column("elements"), inside, strict=True):
                sig = signatures(np.frombuffer(data.as_buffer(), np.uint64), level)
                for outer in within or [None]:
                    yield cid, sig if outer is None else mix(sig ^ mix(np.array([outer]).view(np.uint64), 6), 7)

    return sets.mapInArrow(lambda batches: _packs(found(batches), lambda s, c: _pack(s, c, buckets)), PACKED)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The packed rows of one bucket after another; they come in order of bucket, so one is held at a time."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "kind", "part")]
        columns += [[x.as_buffer() for x in batch.column(c)] for c in ("classes", "counts", "signatures")]
        for bucket, *row in zip(*columns, strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append((bucket, *row))
    if held:
        yield held


def _opened(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, classes, parts and labels (the classes themselves, if none) of the packed rows of a bucket."""
    sigs, classes, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    labels = [np.zeros(0, np.int64)]
    for bucket, kind, part, cls, counts, packed in rows:
        low = np.frombuffer(packed, np.uint8).reshape(-1, LOW_BITS // 8)
        sig = np.zeros((len(low), 8), np.uint8)
        sig[:, : LOW_BITS // 8] = low
        sigs.append(sig.view("<i8").ravel() + (bucket << LOW_BITS))
        own, times = np.frombuffer(cls, np.int64), np.frombuffer(counts, np.int32)
        classes.append(np.repeat(own[: len(times)], times))
        labels.append(np.repeat(own[len(times) :], times) if kind == LABELLED else classes[-1])
        parts.append(np.full(len(low), part, np.int32))
    return tuple(np.concatenate(x) for x in (sigs, classes, parts, labels))


def _by_bucket(packed: DataFrame, buckets: int) -> DataFrame:
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")


def _edges(packed: DataFrame, buckets: int) -> DataFrame:
    """(sig, cid, leader): every class of a signature of two or more, tied to a leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            parts = [
                [np.frombuffer(x, np.int64) for x in (sig, cls, leader)]
                for _, kind, _, cls, leader, sig in rows
                if kind == EDGES
            ]
            sig, cls, *_ = _opened([r for r in rows if r[1] == OPEN])
            parts.append(list(_edges_within(sig, cls)[1:]))
            for columns in parts:
                for start in range(0, len(columns[0]), 20_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[start : start + 20_000]) for c in columns], names=["sig", "cid", "leader"]
                    )

    return _by_bucket(packed, buckets).mapInArrow(run, "sig long, cid long, leader long")


# Elements in company


def _pack_elements(
    elements: np.ndarray, cls: np.ndarray, buckets: int, part: int, labels: dict[int, int] | None = None
) -> Iterator[tuple]:
    """Elements of two classes of the pack are counted here; of each, the shuffle only learns that there are two.

    With ``labels`` (class to label), two classes of one label count as one.
    """
    order = np.argsort(elements)
    elements, cls = elements[order], cls[order]
    label = cls
    if labels is not None:
        own, place = np.unique(cls, return_inverse=True)
        label = np.array([labels[c] for c in own.tolist()], np.int64)[place]
    first, lengths = _runs(elements)
    shared = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    several = np.repeat(shared, lengths)
    cids, counts = np.unique(cls[several], return_counts=True)
    if len(cids):
        bucket = int(mix(np.array([part], np.uint64), 9)[0] % np.uint64(buckets))
        yield bucket, COUNTS, part, cids.tobytes(), counts.astype(np.int64).tobytes(), b""
    known = elements[first[shared]]
    yield from _pack_open(known, np.zeros(len(known), np.int64), buckets, part, KNOWN)
    elements, cls, label = elements[~several], cls[~several], label[~several]
    order = np.argsort(cls, kind="stable")
    elements, cls, label = elements[order], cls[order], label[order]
    if labels is None:
        yield from _pack_open(elements, cls, buckets, part)
    else:
        yield from _pack_open(elements, cls, buckets, part, LABELLED, label)


def _company(packed: DataFrame, buckets: int) -> DataFrame:
    """(cid, shared): how many elements of each class, as one task met it, are in another class (of another label) too.

    Never too few. A class whose copies are in several tasks is counted for each task by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cid", "part", "shared"]
        for rows in _buckets(batches):
            for _, _, part, cids, counts, _ in (r for r in rows if r[1] == COUNTS):
                own = np.frombuffer(cids, np.int64)
                columns = [own, np.full(len(own), part, np.int32), np.frombuffer(counts, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
            element, cls, part, label = _opened([r for r in rows if r[1] in (OPEN, LABELLED)])
            known = np.unique(_opened([r for r in rows if r[1] == KNOWN])[0])
            order = np.argsort(element)
            element, cls, part, label = element[order], cls[order], part[order], label[order]
            first, lengths = _runs(element)
            if not len(first):
                continue
            shared = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
            shared |= np.isin(element[first], known, assume_unique=True)
            shared = np.repeat(shared, lengths)
            cls, part = cls[shared], part[shared]
            order = np.lexsort((part, cls))
            cls, part = cls[order], part[order]
            first = np.flatnonzero(np.append(True, (cls[1:] != cls[:-1]) | (part[1:] != part[:-1]))[: len(cls)])
            counts = np.diff(np.append(first, len(cls)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cls[first], part[first], counts)], names=names)

    found = _by_bucket(packed, buckets).mapInArrow(run, "cid long, part int, shared long")
    found = found.groupBy("cid", "part").agg(F.sum("shared").alias("shared"))
    return found.groupBy("cid").agg(F.min("shared").alias("shared"))


def _backed(packed: DataFrame, sizes: DataFrame, buckets: int) -> DataFrame:
    """(cid) of the classes in (cid, n) of which other classes hold enough elements for a similar partner."""
    shared = _company(packed, buckets).join(sizes, "cid")
    return shared.where(F.col("shared") * 100 >= F.col("n") * PERCENT).select("cid")


def _elements_of_texts(texts: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Packed elements straight from the texts; a class that a task has met is not emitted again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), set()

        def found() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for text in batch.column("text"):
                    elements = shingles(text.as_py())
                    cid = class_of(elements, seed)[0]
                    if len(elements) and cid not in seen:
                        seen.add(cid)
                        yield cid, elements

        return _packs(found(), lambda e, c: _pack_elements(e, c, buckets, part))

    return texts.select("text").mapInArrow(run, PACKED)


def _elements_of_sets(sets: DataFrame, buckets: int) -> DataFrame:
    """Packed elements of (cid, elements, comp); classes of one comp count as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[int, int] = {}

        def found() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                columns = (batch.column("cid").to_pylist(), batch.column("comp").to_pylist())
                for cid, comp, data in zip(*columns, batch.column("elements"), strict=True):
                    labels[cid] = comp
                    yield cid, np.frombuffer(data.as_buffer(), np.uint64)

        return _packs(found(), lambda e, c: _pack_elements(e, c, buckets, 0, labels))

    return sets.select("cid", "elements", "comp").mapInArrow(run, PACKED)


def _partners(sets: DataFrame, families: DataFrame, buckets: int) -> DataFrame:
    """(cid, n, comp, most) of the classes that can have a similar partner in another family, of size ``most`` or less."""
    labelled = sets.join(families, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    shared = _company(_elements_of_sets(labelled, buckets), buckets)
    most = F.expr(f"shared * {100 + PERCENT} div {PERCENT} - n")
    return (
        labelled.select("cid", "n", "comp")
        .join(shared, "cid")
        .select("cid", "n", "comp", most.alias("most"))
        .where(F.col("most") * 100 >= F.col("n") * PERCENT)
    )


# Comparing sets


def sketch(elements: np.ndarray, fine: bool = False) -> np.ndarray:
    """How many elements are in each part of the domain: SKETCH parts, or as ``fine`` one for one or two elements."""
    parts = max(SKETCH, 1 << (len(elements) // 2).bit_length()) if fine else SKETCH
    places = (elements % np.uint64(parts)).astype(np.int64)
    return np.minimum(np.bincount(places, minlength=parts), 255).astype(np.uint8)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """In how many elements sets of these sketches differ at least; the finer sketch is folded to the other's parts."""
    parts = min(len(x), len(y))
    folded = [np.minimum(v.astype(np.int64).reshape(-1, parts).sum(0), 255) for v in (x, y)]
    return int(np.abs(folded[0] - folded[1]).sum())


def _sketches(sets: DataFrame, fine: bool = False) -> DataFrame:
    """(cid, n, sketch) of (cid, n, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(np.frombuffer(x.as_buffer(), np.uint64), fine).tobytes() for x in batch.column("elements")]
            columns = [batch.column("cid"), batch.column("n"), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "n", "sketch"])

    return sets.mapInArrow(run, "cid long, n long, sketch binary")


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that sketches leave: parts of the domain differ no more than the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            apart = [
                least_difference(*(np.frombuffer(v.as_buffer(), np.uint8) for v in pair))
                for pair in zip(batch.column("x"), batch.column("y"), strict=True)
            ]
            near = np.array(apart, np.int64) * (100 + PERCENT) <= total * (100 - PERCENT)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = sketches.select(F.col("cid").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("n_a"))
    right = sketches.select(F.col("cid").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("n_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                keep.append(_similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("cid").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("cid").alias("b"), F.col("elements").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) for every class with a link: comp is the smallest class it can reach."""
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    mark = F.struct(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"))
    before = edges.select(mark.alias("m")).first()["m"]
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(
            small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"
        )
        after = edges.select(mark.alias("m")).first()["m"]
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("cid"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp")).unionByName(roots)


# The join


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    """(key, doc_id, n, cid, check) of every document; key and doc_id find its text again."""
    names = ["key", "doc_id", "n", "cid", "check"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column("text"):
                elements = shingles(text.as_py())
                made.append((len(elements), *class_of(elements, seed)))
            columns = list(zip(*made, strict=True)) or [()] * (len(names) - 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in columns)],
                names=names,
            )

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


SETS = "cid long, n long, elements binary"


def _sets(texts: DataFrame, seed: int, once: bool) -> DataFrame:
    """(cid, n, elements) of texts that have any; ``once``: each class once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows, size = [], 0
            for text in batch.column("text"):
                elements = shingles(text.as_py())
                cid = class_of(elements, seed)[0]
                if not len(elements) or (once and cid in seen):
                    continue
                seen.add(cid)
                rows.append((cid, len(elements), elements.tobytes()))
                size += elements.nbytes
                if size > 1 << 24:
                    yield _set_batch(rows)
                    rows, size = [], 0
            yield _set_batch(rows)

    return texts.mapInArrow(run, SETS)


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SETS.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.binary() if x == "elements" else pa.int64()) for c, x in zip(columns, names, strict=True)],
        names=names,
    )


def near_duplicates(
    docs: DataFrame, few: int = FEW, levels: int = LEVELS, block_classes: int = BLOCK_CLASSES
) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, kept), one row per row of ``docs``; ``key`` hashes its text."""
    texts = docs.select(F.xxhash64("text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, seed = _classified(texts)
    facts = rows.where("n > 0").groupBy("cid").agg(F.first("n").alias("n"))
    total = facts.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets_for = lambda size: max(tasks, math.ceil(size / BUCKET))
    buckets = buckets_for(total)
    asked = _backed(_elements_of_texts(texts, seed, buckets), facts, buckets)
    sets = _candidate_sets(texts, rows, stored(asked, "backed"), seed)
    total = sets.agg(F.sum("n")).first()[0] or 0
    sizes = sets.select("cid", "n")
    buckets = buckets_for(2 * PER_ELEMENT * total)  # a set takes part in two bands
    members = stored(_members(stored(_edges(_emit(sets, 0, buckets), buckets), "signatures")), "members")
    ties = stored(_ties(members, sizes), "ties")
    families = components(ties)
    links = stored(_led(ties, sets, block_classes, tasks), "links")
    links = stored(links.unionByName(_within(families, components(links), sets, block_classes, tasks)), "links")
    partners = stored(_partners(sets, families, buckets_for(total)), "partners")
    sets = stored(sets.join(partners.select("cid"), "cid", "left_semi"), "sets")
    coarse, fine = (stored(_sketches(sets, fine), "sketches") for fine in (False, True))
    coarse = coarse.join(partners.select("cid", "most"), "cid")
    for level in range(levels + 1):
        open_ = stored(_open(members, partners), "open")
        small = F.lit(level == levels) | (F.col("pairs") <= few * F.col("members"))
        large = stored(open_.where(~small), "large")
        pairs = stored(_pairs(open_.where(small), coarse, tasks).distinct(), "pairs")
        found = _compared(stored(_near(pairs, fine), "pairs"), sets)
        links = stored(links.unionByName(found), "links")
        if large.isEmpty():
            break
        inside = large.groupBy("cid").agg(F.collect_set("sig").alias("inside"))
        size = partners.join(inside, "cid").agg(F.sum(F.col("n") * F.size("inside"))).first()[0]
        buckets = buckets_for(2 * PER_ELEMENT * size)
        edges = stored(_edges(_emit(sets.join(inside, "cid"), level + 1, buckets), buckets), "signatures")
        members = stored(_members(edges), "members")
    return _labelled(rows, components(links))


def _classified(texts: DataFrame) -> tuple[DataFrame, int]:
    """The rows with their classes, and the seed with which no two sets have one class."""
    for seed in range(SEEDS):
        rows = stored(_rows(texts, seed), "shingled")
        clash = rows.groupBy("cid").agg(F.min("check").alias("low"), F.max("check").alias("high"))
        if clash.where("low <> high").isEmpty():
            return rows, seed
    raise RuntimeError(f"different sets have one 64-bit fingerprint under each of {SEEDS} seeds")


def _ties(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): each class with the leader that it shares most signatures with, if these are enough."""
    ranks = members.groupBy("cid").agg(F.count(F.lit(1)).alias("rank"))
    lead = members.join(ranks, "cid").groupBy("sig").agg(F.max(F.struct("rank", "cid")).alias("lead"))
    shared = (
        members.join(lead.select("sig", F.col("lead.cid").alias("b")), "sig")
        .where("cid <> b")
        .groupBy("cid", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = shared.groupBy("cid").agg(F.max(F.struct("n", "b")).alias("best"))
    return (
        best.join(sizes, "cid")
        .where(f"best.n >= 2 and best.n * {TIE} >= n")
        .select(F.col("cid").alias("a"), F.col("best.b").alias("b"))
    )


def _led(ties: DataFrame, sets: DataFrame, block_classes: int, parts: int) -> DataFrame:
    """The ties (a, b) of classes that are similar to their leader, which is dealt with at most ``block_classes`` of them."""
    sizes = ties.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / block_classes).cast("int").alias("salts"))
    leads = sizes.select(F.col("b").alias("cid"), F.lit(None).cast("long").alias("leader"), "salts")
    led = ties.join(sizes, "b").select(F.col("a").alias("cid"), F.col("b").alias("leader"), "salts")
    rows = sets.select("cid", "elements").join(leads.unionByName(led), "cid")
    every = F.sequence(F.lit(0), F.col("salts") - 1)
    one = F.array(F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int"))
    key = ["head", "salt"]
    dealt = rows.select(
        F.coalesce("leader", "cid").alias("head"),
        F.explode(F.when(F.col("leader").isNull(), every).otherwise(one)).alias("salt"),
        F.col("leader").isNotNull().alias("led"),
        "cid",
        "elements",
    )
    dealt = dealt.repartition(parts, *key).sortWithinPartitions(*key, "led")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("head", "led", "cid"))
            for head, led, cid, data in zip(*columns, batch.column("elements"), strict=True):
                elements = np.frombuffer(data.as_buffer(), np.uint64)
                if not led:
                    first = elements
                elif _similar(first, elements):
                    found.append((cid, head))
            columns = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.intersect1d(x, y, assume_unique=True).size
    return 100 * both >= PERCENT * (x.size + y.size - both)


def _within(families: DataFrame, linked: DataFrame, sets: DataFrame, block_classes: int, parts: int) -> DataFrame:
    """(a, b): edges that connect the similar classes of each family, beside those in ``linked``.

    The classes of a family's largest linked group need no comparison with each other; the
    rest is compared with all.
    """
    known = families.join(linked.withColumnRenamed("comp", "part"), "cid", "left")
    known = known.withColumn("part", F.coalesce("part", "cid")).join(sets.select("cid", "n"), "cid")
    groups = known.groupBy("comp", "part").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("total"))
    main = groups.groupBy("comp").agg(
        F.max(F.struct("classes", "total", "part")).alias("main"),
        F.sum("classes").alias("classes"),
        F.sum("total").alias("total"),
    )

    def blocks(classes, total):
        return F.greatest(F.ceil(classes / block_classes), F.ceil(total * 8 / BLOCK_BYTES)).cast("int")

    main = main.where("classes > main.classes").select(
        "comp",
        F.col("main.part").alias("main"),
        blocks(F.col("classes") - F.col("main.classes"), F.col("total") - F.col("main.total")).alias("rest"),
        blocks(F.col("main.classes"), F.col("main.total")).alias("mains"),
    )
    placed = stored(known.join(main, "comp").drop("n"), "families").join(sets.select("cid", "elements"), "cid")
    number = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    in_main = F.col("part") == F.col("main")
    own = F.when(in_main, F.col("rest") + number("mains")).otherwise(number("rest"))
    others = F.when(in_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains"))
    spread = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    keyed = spread.select(
        "comp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "cid", "elements"
    )
    key = ["comp", "low", "high"]
    ordered = keyed.repartition(parts, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cids, elements = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in key), strict=True)
            for k, cid, data in zip(keys, batch.column("cid").to_pylist(), batch.column("elements"), strict=True):
                if k != now:
                    yield from _block_edges(cids, elements)
                    now, cids, elements = k, [], []
                cids.append(cid)
                elements.append(np.frombuffer(data.as_py(), np.uint64))
        yield from _block_edges(cids, elements)

    return ordered.mapInArrow(run, "a long, b long")


def _block_edges(cids: list[int], elements: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One edge from each class to the first of those it is connected with inside the block."""
    m = len(cids)
    if m < 2:
        return
    sizes = np.array([len(e) for e in elements])
    _, column, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    several = count > 1
    place = np.cumsum(several) - 1
    use = several[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((m, m), np.float32)
    width = 2048
    for start in range(0, int(several.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        table = np.zeros((m, width), np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        both += table @ table.T
    similar = 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)
    first = np.full(m, -1)
    for i in range(m):
        if first[i] < 0:
            reached = similar[i].copy()
            reached[i] = True
            todo = np.flatnonzero(reached & (first < 0))
            while len(todo):
                first[todo] = i
                todo = np.flatnonzero(similar[todo].any(0) & (first < 0))
    at = np.flatnonzero(first != np.arange(m))
    names = np.array(cids, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[first[at]])], names=["a", "b"])


def _candidate_sets(texts: DataFrame, rows: DataFrame, asked: DataFrame, seed: int) -> DataFrame:
    """The sets of the classes asked for, each made from one text of its class."""
    one = (
        rows.join(asked, "cid")
        .groupBy("cid")
        .agg(F.min(F.struct("key", "doc_id")).alias("row"))
        .select(F.col("row.key").alias("o_key"), F.col("row.doc_id").alias("o_id"))
    )
    same = (F.col("key") == F.col("o_key")) & F.col("doc_id").eqNullSafe(F.col("o_id"))
    sets = stored(_sets(texts.join(one, same, "left_semi"), seed, once=True), "sets")
    if sets.groupBy("cid").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        return sets
    # Rows that repeat both id and text, in different tasks.
    return stored(sets.dropDuplicates(["cid"]), "sets")


def _members(edges: DataFrame) -> DataFrame:
    """(sig, cid): the classes of every signature of two or more."""
    return edges.select("sig", "cid").unionByName(
        edges.select("sig", F.col("leader").alias("cid")).distinct()
    )


def _open(members: DataFrame, partners: DataFrame) -> DataFrame:
    """(sig, cid, comp, members, pairs) of the signatures with classes of ``partners`` in two or more families.

    ``comp`` is the family, ``pairs`` the number of pairs of the signature's classes across families.
    """
    labelled = members.join(partners.select("cid", "comp"), "cid")
    by_comp = labelled.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("n"))
    by_sig = by_comp.groupBy("sig").agg(
        F.count(F.lit(1)).alias("comps"),
        F.sum("n").alias("members"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    )
    by_sig = by_sig.where("comps > 1").select(
        "sig", "members", ((F.col("members") * F.col("members") - F.col("squares")) / 2).alias("pairs")
    )
    return labelled.join(by_sig, "sig")


def _pairs(small: DataFrame, coarse: DataFrame, parts: int) -> DataFrame:
    """(a, b), a < b: the pairs across families in a signature that sizes, their bounds and sketches leave."""
    names = ["sig", "cid", "comp", "n", "most", "sketch"]
    rows = small.select("sig", "cid", "comp").join(coarse, "cid").select(*names)
    rows = rows.repartition(parts, "sig").sortWithinPartitions("sig", "n")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        now, held = None, []
        for batch in batches:
            numbers = [batch.column(c).to_numpy() for c in names[:-1]]
            cells = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            for start, n in zip(*(x.tolist() for x in _runs(numbers[0])), strict=True):
                if numbers[0][start] != now and held:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held = []
                now = numbers[0][start]
                held.append([x[start : start + n] for x in (*numbers[1:], cells)])
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros((2, 0), np.int64)], 0
        for found in itertools.chain.from_iterable(_pairs_of_signature(*group) for group in groups(batches)):
            held.append(found)
            size += found.shape[1]
            if size > HELD:
                yield _pair_batch(held)
                held, size = held[:1], 0
        yield _pair_batch(held)

    return rows.mapInArrow(run, "a long, b long")


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found, 1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["a", "b"])


def _pairs_of_signature(
    cid: np.ndarray, comp: np.ndarray, n: np.ndarray, most: np.ndarray, cells: np.ndarray
) -> Iterator[np.ndarray]:
    """The pairs of one signature that may be similar, two rows of classes; classes come in ascending order of size."""
    last = np.searchsorted(n, most, side="right").tolist()
    for i in range(len(n) - 1):
        later = slice(i + 1, last[i])
        possible = (comp[later] != comp[i]) & (most[later] >= n[i]) & (n[i] * 100 >= n[later] * PERCENT)
        at = i + 1 + np.flatnonzero(possible)
        if not len(at):
            continue
        apart = (np.maximum(cells[at], cells[i]) - np.minimum(cells[at], cells[i])).sum(1, dtype=np.int64)
        at = at[apart * (100 + PERCENT) <= (n[at] + n[i]) * (100 - PERCENT)]
        if len(at):
            yield np.stack([np.minimum(cid[at], cid[i]), np.maximum(cid[at], cid[i])])


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    filled = rows.where("n > 0").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    # A real id comes before none; of rows with one id, the smaller text hash.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    least = filled.groupBy("comp").agg(F.min(place).alias("first"))
    out = filled.join(least, "comp", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("first.doc_id").alias("component_id"),
        "key",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))).alias("kept"),
    )
    none = rows.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key", F.lit(True).alias("kept")
    )
    return out.unionByName(none)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the one with the smallest doc_id.

    A document without words is in no group and stays. Rows that repeat both doc_id and
    text are one document.
    """
    kept = stored(
        near_duplicates(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("key").alias("k_key")), "kept"
    )
    same = docs["doc_id"].eqNullSafe(kept["k_id"]) & (F.xxhash64("text") == kept["k_key"])
    out = docs.join(kept, same, "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
