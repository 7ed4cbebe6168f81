"""The trie of conversations against a trie in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

from tallyframe.llm.prefix_trie import FAMILY, as_they_are, rebuilt, trie, turns_of

ROWS = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as POS").repartition(3)


def brute(conversations):
    """The nodes of {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(conversations):
        turns = tuple(conversations[conv])
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(conv)
        ends[turns].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(path[-1][1].encode().split()) if path else 0
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[c] for c in children[path])
    sha = lambda path: hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(p))
        for p, m in list(members.items())
    )


def in_order(rows):
    out = defaultdict(list)
    order = lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")
    for conv, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], *order(r))):
        out[conv].append((role or "", text or ""))
    return out


def borrowed(conversations):
    out = {}
    for conv, turns in conversations.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = conversations.get(conv - conv % FAMILY, [])[:h] + turns[h:]
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1]))


def random_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 3, 4, 6, 9])):
            rows.append((conv * 3, turn, rng.choice(["user", "assistant"]), f"say {rng.randrange(2)} " * (turn % 3)))
    rng.shuffle(rows)
    return rows


def test_random_conversations(spark):
    rows = random_rows(1)
    turns = turns_of(table(spark, rows))
    assert got(trie(as_they_are(turns))) == brute(in_order(rows))
    want = brute(borrowed(in_order(rows)))
    assert got(trie(rebuilt(turns))) == want
    for shard in (1, 2, 7):
        assert got(trie(rebuilt(turns), shard)) == want


def test_one_long_conversation_and_many_copies(spark):
    long = [(5, t, "user", f"turn {t}") for t in range(700)]
    copies = [(c, t, "user", f"turn {t}") for c in range(20, 420) for t in range(2)]
    rows = long + copies
    assert got(trie(as_they_are(turns_of(table(spark, rows))), 64)) == brute(in_order(rows))


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "first"), (0, 3, None, None), (0, 3, None, None), (0, -1, "a", "x " * 40_000), (1, 0, "", ""),
        (None, 0, "user", "no conversation"), (7, 0, "user", "only one"), (45, 0, "user", "one"), (45, 1, "user", None),
        (46, 5, "ab", "c"), (47, 5, "a", "bc"),
    ]
    turns = turns_of(table(spark, rows))
    want = brute(borrowed(in_order(rows)))
    assert got(trie(rebuilt(turns))) == want
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want), "some conversation is turnless"
    assert trie(rebuilt(turns_of(table(spark, rows).limit(0)))).count() == 0
