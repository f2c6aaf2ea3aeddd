"""Sharding: a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in an order of its own (an offset and a step, both hashed from its
name) and shards take turns claiming the next slot in that order that is free. Each shard ends with an equal share of
the slots, to within one (weights: to within one turn), and when a shard comes or goes few other slots change hands.
A row's key is hashed to a slot; the table, whose size is fixed by its prime, is broadcast, so placing a row is one lookup.

Defined cases: a null key is placed like the empty text; equal keys go to the same shard; no shards is an error; an
empty table gives no rows; other columns are passed through, and a column of the input that is named like the result's is replaced.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots, a prime well over 100 times the number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def fill(shards=SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """Slot -> number of the shard (its place in `shards`). slots must be prime. A shard of weight w claims w slots a turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime, no smaller than the number of shards")
    at = [xxhash.xxh64_intdigest(s, seed=1) % slots for s in shards]
    step = [xxhash.xxh64_intdigest(s, seed=2) % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner, free = [-1] * slots, slots
    turns = [k for k, s in enumerate(shards) for _ in range((weights or {}).get(s, 1))]
    while free:
        for k in turns:
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 60 bits of the MD5 of a key as text, modulo the slots: any engine can work it out."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard(rows: DataFrame, key_col: str = "doc_id", shards=SHARDS, slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """rows with slot (int) and shard (its name)."""
    spark = rows.sparkSession
    names = F.array(*[F.lit(s) for s in shards])
    table = spark.createDataFrame(list(enumerate(fill(shards, slots, weights))), "slot int, shard_no int").select("slot", F.element_at(names, F.col("shard_no") + 1).alias("shard"))
    place = slot_of(F.col(key_col), slots)
    kept = rows.drop(*[c for c in ("slot", "shard") if c != key_col])
    # The table has `slots` rows, whatever the input's size.
    return kept.withColumn("slot", place).join(F.broadcast(table), "slot")
