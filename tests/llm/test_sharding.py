import hashlib
from collections import Counter

import pytest

from factloom.llm import sharding

from .texts import AWKWARD, documents


def test_shares_are_equal_and_moves_few():
    owner = sharding.fill()
    count = Counter(owner)
    assert len(owner) == sharding.SLOTS and len(count) == 64 and max(count.values()) - min(count.values()) <= 1
    fewer = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 63)
    assert moved < 0.05 * sharding.SLOTS


def test_first_claims_follow_preference():
    owner = sharding.fill(("a", "b", "c"), 7)
    import xxhash

    first = xxhash.xxh64_intdigest("a", seed=1) % 7
    assert owner[first] == 0 and sorted(Counter(owner).values()) == [2, 2, 3]
    assert Counter(sharding.fill(("a", "b"), 101, {"b": 3}))[1] in range(74, 78)
    for bad in ((), ("a", "a")):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(("a",), 8)


def test_rows_are_placed_by_key(spark):
    docs = documents(spark, AWKWARD)
    docs = docs.union(docs).withColumn("shard", docs.lang)
    rows = sharding.shard(docs).collect()
    owner = sharding.fill()
    assert len(rows) == 2 * len(AWKWARD)
    assert all(r.shard == sharding.SHARDS[owner[r.slot]] for r in rows)
    assert all(r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len(AWKWARD)
    by_null = sharding.shard(docs.limit(2).selectExpr("cast(null as long) as doc_id")).collect()
    assert len({r.shard for r in by_null}) == 1
    assert sharding.shard(docs.limit(0)).count() == 0
