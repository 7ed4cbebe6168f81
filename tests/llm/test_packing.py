import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyframe.llm.columns import read
from tallyframe.llm.packing import configurations, cut_pieces, make_plan, pack, pack_documents, sequences
from tallyframe.llm.scratch import stored
from tallyframe.llm.tokens import BYTE_BPE

from tests.llm.helpers import DATA, table


def check_plan(counts, plan):
    used, spans = np.zeros(plan.sequences, int), defaultdict(list)
    for length, lo, hi, base in plan.runs:
        used[base : base + hi - lo] += length
        spans[length].append((lo, hi))
    for length, n in counts.items():
        ends = sorted(spans[length])
        assert ends[0][0] == 0 and ends[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert not len(used) or (used.max() <= plan.capacity and used.min() > 0)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_piece_once_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 1025, 5000), rng.integers(300, 420, 3000), rng.integers(1, 90, 4000),
               np.append(rng.integers(500, 700, 2000), rng.integers(5, 40, 800))][seed]
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = make_plan(counts)
    check_plan(counts, plan)
    least = int(lengths.sum()) / 1024
    if len(counts) < 300:  # the relaxed program over the exact lengths bounds any packing from below
        sizes = sorted(counts)
        least = max(least, sum(n for _, n in configurations(sizes, [counts[s] for s in sizes], 1024)))
    assert least <= plan.sequences <= 1.01 * least + 2


def test_linear_grouping_beats_best_fit_alone_where_configurations_matter():
    counts = {length: 700 for length in range(330, 390, 5)}
    alone = make_plan(counts, large_shares=(2.0,))
    plan = make_plan(counts)
    check_plan(counts, plan)
    assert plan.sequences < 0.98 * alone.sequences


def expected(rows):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = list(range(len(ids) % 1024, len(ids) + 1, 1024))
        cuts = cuts if cuts[0] == 0 else [0, *cuts]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out.append((doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check_packed(rows, packed):
    got = packed.collect()
    found = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]
    assert sorted(found, key=str) == expected(rows)
    inside = defaultdict(list)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
    for parts in inside.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, "short"), (4, "long words here " * 9000), (4, "again"), (4, "again"), (None, "no id"),
        (5, "x"), (6, "a b\n\n c  d\té <|endoftext|>"),
    ]
    check_packed(rows, pack_documents(table(spark, rows, "7 as LENGTH")))
    assert pack_documents(table(spark, rows).limit(0)).count() == 0


def test_documents(spark):
    docs = read(spark, f"{DATA}/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_packed(rows, pack_documents(docs))


def test_sequences_hold_the_ids(spark):
    docs = table(spark, [(i, f"text number {i} " * (i + 1)) for i in range(60)])
    pieces = stored(cut_pieces(docs, keep_ids=True), "pieces")
    packed = pack(pieces)
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in packed.collect():
        part = bytes(whole[r.sequence_id])[4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(part) == r.ids_crc32
