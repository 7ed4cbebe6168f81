import hashlib
import random
from collections import defaultdict

import pytest

from tallyframe.llm import exact_dedup
from tallyframe.llm.exact_dedup import CHUNK, Fingerprinter, drop_copies, exact_groups

from tests.llm.helpers import table


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        groups[low].append(doc_id)
    out = []
    for low, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = max(real, default=None)
        sha = hashlib.sha256(low.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=str)


ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "É x"), (5, "é x"), (6, None), (7, ""),
    (8, " "), (9, "a" * 200_000 + "b"), (10, "A" * 200_000 + "b"), (11, "a" * 200_000 + "c"),
    (None, "same text"), (None, "alone"), (12, "twice"), (12, "twice"),
]


@pytest.mark.parametrize("printer", [None, Fingerprinter((2, 3), (1, 1))], ids=["usual", "clashing"])
def test_groups_match_brute_force(spark, printer):
    got = exact_groups(table(spark, ROWS, "1 as KEPT"), printer).collect()
    rows = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]
    assert sorted(rows, key=str) == expected(ROWS)
    kept = sorted(r.doc_id for r in got if r.kept and r.doc_id is not None)
    assert kept == [3, 4, 5, 7, 8, 10, 11, 12]
    assert sum(r.kept for r in got) == len({low for *_, low in expected(ROWS)})


def test_one_row_of_each_text_stays_with_all_columns(spark):
    docs = table(spark, ROWS, "2 as text_sha256")
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({low for *_, low in expected(ROWS)})


def test_empty_table(spark):
    assert exact_groups(table(spark, ROWS).limit(0)).count() == 0


def test_fingerprints_combine_whatever_the_chunks():
    data = random.Random(1).randbytes(3 * CHUNK + 17)
    whole = Fingerprinter().block(data)
    for chunk in (1, 7, 64, CHUNK):
        assert Fingerprinter(chunk=chunk).block(data) == whole
    printer = Fingerprinter()
    for cut in (0, 1, CHUNK, len(data)):
        a, b = printer.block(data[:cut]), printer.block(data[cut:])
        assert printer.combine(a, b, len(data) - cut) == whole
    for p, x, h in zip(printer.primes, printer.bases, whole, strict=True):
        value = 0
        for byte in data:
            value = (value * x + byte) % p
        assert value == h


def test_rows_that_share_an_id_meet_their_own_fingerprint_only(spark, monkeypatch):
    rows = [(i, f"text {n}") for i in (None, 7) for n in range(5)] * 2
    compared = []
    pieces = exact_dedup._pieces
    monkeypatch.setattr(exact_dedup, "_pieces", lambda df: compared.append(df.count()) or pieces(df))
    monkeypatch.setattr(exact_dedup, "_split_clashes", lambda *_: pytest.fail("no text clashes"))
    got = exact_groups(table(spark, rows)).collect()
    assert compared == [len(rows)]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(rows)
