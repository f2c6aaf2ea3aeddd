"""URL filters: a Bloom filter cascade.

Keys are rule strings: a host and a start of a path. Level 0 holds the listed keys; level 1 holds the keys of the
corpus that level 0 takes wrongly; level 2 the listed keys that level 1 takes; and so on until no key is wrong. Over
the universe the cascade was made for (every key of every url of the corpus) membership is exact, so urls are judged
by looking at a few bits, with no join. Level 0's error rate is set from the universe's size, so every level has about as
many keys as are listed: what is broadcast grows with the list, not with the corpus.

Two cascades answer a key: is it listed, and, over the listed keys, does it block.

A key longer than every rule's host or path can be none of them, so urls give keys up to those lengths only: few and
short ones, however long the url is, and among them every key that a rule could equal.

Defined cases: a null url, or one without "://", has empty host and path and fits no rule; a rule given twice counts once
(the last verdict stands); an empty rule list fits nothing; repeated rows are judged each; an empty table gives no rows;
other columns are not read. The longest rule wins, between equals the one with the longer host.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: (host and path, verdict) of the production rules.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty where there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, hosts: Iterable[str], lengths: Iterable[int]) -> Column:
    """Every key that a rule with one of these hosts and a path of one of these lengths could fit by: host suffixes at dots, with path starts.

    A suffix has no more labels and characters than the longest host listed: of a url's labels only the last few are looked at.
    """
    hosts = list(hosts)
    most, longest = max((h.count(".") + 1 for h in hosts), default=1), max(map(len, hosts), default=0)
    labels = F.split(host, r"\.")
    last = F.slice(labels, F.greatest(F.size(labels) - most + 1, F.lit(1)), F.lit(most))
    n = F.size(last)
    suffixes = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(last, i, n - i + 1), ".")), lambda s: F.length(s) <= longest)
    cuts = F.filter(F.array(*[F.lit(int(x)) for x in sorted(set(lengths))]), lambda m: m <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda m: F.concat(s, F.substring(path, F.lit(1), m)))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


class Level:
    """One Bloom filter."""

    def __init__(self, n: int, rate: float, seed: int):
        self.bits = max(64, math.ceil(1.4427 * math.log2(1 / rate) * max(n, 1)))
        self.hashes = max(1, round(math.log2(1 / rate)))
        self.seed = seed
        self.words = np.zeros(-(-self.bits // 64), np.uint64)

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        a, b = h >> 64, (h & (1 << 64) - 1) | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def add(self, places: Iterable[int]) -> None:
        for p in places:
            self.words[p >> 6] |= np.uint64(1 << (p & 63))

    def __contains__(self, key: str) -> bool:
        words = self.words
        return all(int(words[p >> 6]) >> (p & 63) & 1 for p in self.places(key))


class Cascade:
    """Exact membership over the universe that it was built for."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for depth, level in enumerate(self.levels):
            if key not in level:
                return depth % 2 == 1  # a listed key is in every even level before
        return len(self.levels) % 2 == 1


def taken(level: Level, keys: DataFrame) -> DataFrame:
    """The keys that the level takes."""

    @F.pandas_udf("boolean")
    def inside(column: pd.Series) -> pd.Series:
        return column.map(level.__contains__).astype(bool)

    return keys.where(inside("key"))


def filled(level: Level, keys: DataFrame) -> Level:
    """The level with all the keys in it: tasks find bits, distinct bits are gathered. At most one number for each bit of the level."""

    @F.pandas_udf("array<long>")
    def places(column: pd.Series) -> pd.Series:
        return column.map(level.places)

    level.add(r[0] for r in keys.select(F.explode(places("key")).alias("p")).distinct().toLocalIterator())
    return level


def build(listed: set[str], universe: DataFrame, size: int, rate: float = 0.5) -> Cascade:
    """listed: the keys to take. universe: `key`, all others that will ever be asked for (listed ones among them do no harm); size: at least its rows."""
    first_rate = min(0.5, max(len(listed), 1) / (1.4143 * max(size, 1)))
    levels = [Level(len(listed), first_rate, 0)]
    for key in listed:
        levels[0].add(levels[0].places(key))

    @F.pandas_udf("boolean")
    def other(column: pd.Series) -> pd.Series:
        return ~column.isin(listed)

    wrong, left = written(taken(levels[0], universe).where(other("key")).distinct()), set(listed)
    n = wrong.count()
    while n:
        levels.append(filled(Level(n, rate, len(levels)), wrong))
        left = {k for k in left if k in levels[-1]}
        if not left:
            break
        levels.append(Level(len(left), rate, len(levels)))
        for key in left:
            levels[-1].add(levels[-1].places(key))
        wrong = written(taken(levels[-1], wrong))
        n = wrong.count()
    return Cascade(levels)


def build_local(listed: set[str], others: set[str], rate: float = 0.5) -> Cascade:
    """The same over a universe that is itself a rule list."""
    levels, inside, outside = [], set(listed), set(others)
    while inside or not levels:
        levels.append(Level(len(inside), rate, 1000 + len(levels)))
        for key in inside:
            levels[-1].add(levels[-1].places(key))
        inside, outside = {k for k in outside if k in levels[-1]}, inside
    return Cascade(levels)


def judge(pages: DataFrame, rules=RULES, other: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (the longest that fits, or null) and verdict (its, or `other`) of each url."""
    verdicts = dict(rules)
    hosts = {k.partition("/")[0] for k in verdicts}
    lengths = {len(k) - len(k.partition("/")[0]) for k in verdicts} or {0}
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("keys", keys_of(F.col("host"), F.col("path"), hosts, lengths))
    size = parts.agg(F.sum(F.size("keys"))).first()[0] or 0
    listed = build(set(verdicts), parts.select(F.explode("keys").alias("key")), size)
    blocked = {k for k, v in verdicts.items() if v == "block"}
    blocking = build_local(blocked, set(verdicts) - blocked)

    def verdict_of(batches):
        known: dict[str, bool] = {}
        for batch in batches:
            found, verdicts_found = [], []
            for of_url in batch.column(3).to_pylist():
                best = None
                for key in of_url:
                    hit = known.get(key)
                    if hit is None:
                        if len(known) > 200_000:
                            known.clear()
                        hit = known[key] = key in listed
                    if hit and (best is None or (len(key), key.find("/")) > (len(best), best.find("/"))):
                        best = key
                found.append(best)
                verdicts_found.append(other if best is None else "block" if best in blocking else "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string()), pa.array(verdicts_found, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(verdict_of, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
