import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import periodic

from .texts import AWKWARD, documents


def brute_runs(words):
    """By the definition: every lag, every maximal stretch, smallest period of a stretch first."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q):
                out.setdefault((i, length), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    """Words of a few letters with periodic stretches of many periods, some within others, some beside each other."""
    letters = rng.choice(["a", "ab", "abc", "abcdefghij", [f"w{k}" for k in range(300)]])
    out = []
    while len(out) < rng.choice([5, 30, 200, 500]):
        kind = rng.random()
        if kind < 0.3:
            out += [rng.choice(letters) for _ in range(rng.randrange(1, 40))]
        elif kind < 0.8:
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, rng.choice([4, 12, 60])))]
            if rng.random() < 0.3:
                unit = unit[:3] * rng.randrange(1, 9) + unit
            out += (unit * 12)[: rng.randrange(1, 12 * len(unit))]
        else:
            out += out[-rng.randrange(1, 20) :]
    return out


def test_runs_against_brute_force():
    rng = random.Random(3)
    some = 0
    for turn in range(400):
        words = made(rng)
        want = brute_runs(words)
        some += len(want)
        ids = periodic.numbered(words)
        assert periodic.runs(ids) == want, words
        if turn % 4 == 0 and len(ids) > 24:
            assert periodic.runs(ids, frequent=0) == periodic.runs(ids, frequent=10**9) == want
    assert some > 400


def test_lag_counts():
    rng = np.random.default_rng(1)
    for n, kinds in ((30, 2), (400, 7), (900, 300)):
        ids = np.unique(rng.integers(0, kinds, n) ** 2 // kinds, return_inverse=True)[1]
        want = [int((ids[q:] == ids[: n - q]).sum()) for q in range(n // 3 + 1)]
        for frequent in (None, 0, 5, 10**9):
            assert periodic.lag_counts(ids, n // 3, frequent, cells=1500).tolist() == want


def test_long_texts_that_only_repeat():
    assert periodic.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    ids = np.tile(np.arange(7), 30_000)
    assert periodic.runs(ids) == [(0, 210_000, 7)]
    assert len(periodic.runs(np.random.default_rng(2).integers(0, 3, 20_000))) < 20


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def row(doc_id, text, edit):
    words = [w.decode() for w in (text or "").encode().split()]
    words = planted(doc_id, words) if edit else words
    found = brute_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(words), len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))


def test_query_rows(spark):
    rng = random.Random(4)
    texts = [*AWKWARD[:9], "word " * 900, *AWKWARD[10:], *(rng.choice([" ", "\n", "  "]).join(made(rng)) for _ in range(120))]
    docs = documents(spark, texts).withColumn("runs", F.lit("x")).withColumn("h", F.lit(1)).repartition(3)
    for edit in (True, False):
        got = periodic.digests(periodic.detect(periodic.with_periods(docs) if edit else docs)).collect()
        assert sorted(map(tuple, got)) == sorted(row(k, t, edit) for k, t in enumerate(texts))


def test_null_ids_and_repeated_rows(spark):
    docs = documents(spark, ["a b " * 30] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    got = periodic.digests(periodic.detect(periodic.with_periods(docs))).collect()
    assert [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in got] == [(None, 1, 0, 60, 2, 30000)] * 2
