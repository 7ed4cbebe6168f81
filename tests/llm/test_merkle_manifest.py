"""Trees, proofs and versions against a Merkle tree in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.merkle_manifest import (
    build,
    document_leaves,
    fold,
    levels_of,
    proofs,
    replaced,
    siblings_of,
)

from tests.llm.helpers import table


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    said = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha(*said)


def tree(nodes):
    """Root, and for each leaf its siblings with their sides."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at, strict=True):
            if i ^ 1 < len(nodes):
                way.append((nodes[i ^ 1], i % 2))
            else:
                way.append((None, 0))
        at = [i // 2 for i in at]
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], ways


def brute(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0], leaf(*r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        members = sorted(by_lang[lang], key=lambda m: m[:3])
        trees.append((members, *tree([m[2] for m in members])))
    root, upper = tree([t[1] for t in trees])
    out = []
    for (members, subroot, ways), above in zip(trees, upper, strict=True):
        for (_, doc_id, own, r), way in zip(members, ways, strict=True):
            changed = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                changed = leaf(*r[:4], None if r[4] is None else r[4] + 1)
            for sibling, left in way + above:
                changed = sha(changed) if sibling is None else sha(sibling, changed) if left else sha(changed, sibling)
            proof = sha(*(s for s, _ in way + above if s))
            out.append((doc_id, own, subroot, root, proof, changed, changed == root))
    return sorted(out, key=str)


def got(docs, bits):
    rows = proofs(document_leaves(docs), bits).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "siblings"), 256), "changed_root",
        F.expr("changed_root = root"),
    )
    return sorted(map(tuple, rows.collect()), key=str)


def full(rows):
    return [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]


ODD = [
    (1, None), (2, ""), (3, "x " * 50_000), (4, "é漢😀", "ü", None), (4, "é漢😀", "ü", None), (5, "same", "ü", "a"),
    (5, "same", "ü", "b"), (None, "no id", "en", "s"), (None, None, None, None), (-7, "below zero", None, "s"),
    (6, "alone", "zz", "s"), (7, "empty language", "", ""),
]


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_trees_match_plain_python(spark, bits):
    rows = [(i, f"text {i}", "en" if i % 3 else "de", "s") for i in range(61)] + ODD
    assert got(table(spark, rows, "1 as TREE"), bits) == brute(full(rows))


@pytest.mark.parametrize("n", [1, 2, 8, 9])
def test_sizes_around_a_block(spark, n):
    rows = [(i, f"text {i}", "en", "s") for i in range(n)]
    assert got(table(spark, rows), 3) == brute(full(rows))


def test_null_counts_and_empty_tables(spark):
    docs = table(spark, [(i, "t") for i in range(30)]).withColumn("n_chars", F.expr("if(doc_id < 20, null, n_chars)"))
    rows = [(i, "t", "en", "s", None if i < 20 else 1) for i in range(30)]
    assert got(docs, 2) == brute(rows)
    assert got(docs.limit(0), 2) == []


def test_a_version_copies_ancestors_only():
    for n in (1, 2, 5, 8, 13):
        height = levels_of(n)
        hashes = [sha(str(i)) for i in range(n)]
        old = build(hashes, height)
        for i in range(n):
            new = replaced(old, height, i, sha("other"))
            assert new[0] == build([*hashes[:i], sha("other"), *hashes[i + 1 :]], height)[0]
            shared, a, b = 0, old, new
            for level in range(height - 1, -1, -1):
                side = 1 + (i >> level & 1)
                assert a[3 - side] is b[3 - side]
                shared += a[3 - side] is not None
                a, b = a[side], b[side]
            hashes_, sides = siblings_of(old, height, i)
            assert len(hashes_) == shared and fold(sha("other"), hashes_, sides) == new[0]
