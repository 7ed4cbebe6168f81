import random
from collections import defaultdict

import numpy as np

from tallyframe.llm.columns import read
from tallyframe.llm.histogram_sort import Boundaries, as_number, shard_by_bytes

from tests.llm.helpers import DATA, table


def check(docs, shards, **settings):
    got = shard_by_bytes(docs, shards, **settings).selectExpr(
        "shard", "slot", "coalesce(octet_length(text), 0) + 16 as size", "text"
    ).collect()
    assert len(got) == docs.count()
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert not got or 0 <= min(slots) and max(slots) < shards
    return sizes, got


def test_shards_have_near_equal_bytes(spark):
    docs = read(spark, f"{DATA}/sf0.1", "documents")
    sizes, got = check(docs, 40)
    largest, ideal = max(r["size"] for r in got), sum(sizes.values()) / 40
    assert len(sizes) == 40
    assert all(abs(s - ideal) <= largest + 0.002 * ideal for s in sizes.values())


def test_ranges_inside_shards_keep_slots_gapless(spark):
    docs = read(spark, f"{DATA}/sf0.01", "documents")
    sizes, _ = check(docs, 4, range_bytes=100_000)
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_a_hot_text_is_split_and_the_exchange_is_one(spark):
    docs = table(spark, [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(3000)])
    sizes, got = check(docs, 10)
    ideal = sum(sizes.values()) / 10
    assert all(abs(s - ideal) < 0.05 * ideal for s in sizes.values())
    assert len({r.shard for r in got if r.text.startswith("copy")}) >= 3
    plan = shard_by_bytes(read(spark, f"{DATA}/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x"), (None, "x"), (3, "y" * 100_000), (3, "y" * 100_000)]
    docs = table(spark, rows, "'own' as SHARD")
    sizes, _ = check(docs, 3)
    assert sum(sizes.values()) == 6 * 16 + 2 + 200_000
    check(docs.limit(0), 3)


def test_boundaries_find_like_a_sorted_list():
    rng = random.Random(2)
    words = [(rng.randrange(-3, 3), rng.randrange(-3, 3)) for _ in range(400)]
    keys = sorted({as_number(*w) for w in words[:12]})
    found = Boundaries(keys).find(*(np.array(x, np.int64) for x in zip(*words, strict=True)))
    assert found.tolist() == [sum(k <= as_number(*w) for k in keys) for w in words]
