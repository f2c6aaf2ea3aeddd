import hashlib
import random

import numpy as np
import pytest

from factloom.llm import substrings as ss

from .texts import AWKWARD, documents


def brute(rows, window):
    """{(id, text): (words, removed, digest)} straight from the definition."""
    order = lambda i: (i is None, i or 0)
    seen = {}
    split = [(i, t, (t or "").encode().split()) for i, t in rows]
    for i, _, w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key not in seen or order(i) < order(seen[key]):
                seen[key] = i
    out = {}
    for i, t, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if order(seen[tuple(w[p : p + window])]) < order(i):
                gone.update(range(p, p + window))
        out[i, t] = len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    return out


def corpus(rng, n, window):
    """Random documents with passages in common, copies, near copies, periodic stretches."""
    vocab = [f"w{k}" for k in range(30)]
    words = lambda m: [rng.choice(vocab) for _ in range(m)]
    common = [words(rng.randint(window, 3 * window)) for _ in range(4)] + [["ab"] * (2 * window), ["x", "y"] * window]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice([words(rng.randint(0, window)), rng.choice(common), rng.choice(common)[: rng.randint(1, 2 * window)]])
        if out and rng.random() < 0.3:
            w = rng.choice(out).split()
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = "changed"
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    return out


def compare(spark, rows, window, prefixes, limit):
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = ss.digests(ss.dedup(docs, window, prefixes, limit)).collect()
    want = brute(rows, window)
    by_row = sorted(((i is None, i or 0), *want[i, t]) for i, t in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept_sha256) for r in got) == by_row


@pytest.mark.parametrize(("window", "prefixes", "limit"), [(8, (3, 5), 1 << 20), (8, (3, 5), 1500), (8, (3, 5), 200), (6, (6, 6), 300), (50, (16, 32), 1 << 20), (50, (16, 32), 4000)])
def test_against_brute_force(spark, window, prefixes, limit):
    rng = random.Random(window * limit)
    rows = [(k, t) for k, t in enumerate(corpus(rng, 60, window))]
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (None, rows[0][1]), (rows[1][0], rows[2][1]), rows[3]]
    compare(spark, rows, window, prefixes, limit)


def test_awkward_rows(spark):
    compare(spark, [*enumerate([*AWKWARD, *AWKWARD])], 50, (16, 32), 4000)
    compare(spark, [], 50, (16, 32), 4000)


def test_one_prefix_in_ever_other_words(spark):
    """A document that repeats one prefix hundreds of times, each time among other words, and others that share some of these places: groups stay within the limit."""
    rng = random.Random(9)
    prefix = ["p", "q", "r"]
    one = [w for _ in range(400) for w in (*prefix, *[f"w{rng.randrange(50)}" for _ in range(5)])]
    rows = [(k, " ".join(one[a : a + n])) for k, (a, n) in enumerate([(0, len(one)), (0, 900), (333, 1000), (800, 40), (0, len(one) - 1)])]
    for limit in (1 << 20, 3000):
        compare(spark, rows, 8, (3, 5), limit)
    every = ss.prefixes_of(ss.keyed(spark.createDataFrame(rows, "doc_id long, text string")), 8, 3)
    assert every.agg({"times": "max"}).first()[0] > 50


def test_maximal_repeats(spark):
    texts = ["a b c d e f g h i j", "x a b c d y f g h i j z", "a b c d e f g h i j", "q w e r t y"]
    got = ss.maximal_repeats(documents(spark, texts), window=4, prefixes=(2, 3)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 4), (1, 6, 5), (2, 0, 10)]


def test_ids_must_be_numbers(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        ss.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_other_columns_stay(spark):
    docs = documents(spark, ["a b c d", "z a b c d q"]).selectExpr("*", "1 as ord", "'x' as starts", "2 as n_words", "map('k', 1) as row")
    got = ss.dedup(docs, 3, (2, 3)).orderBy("doc_id").collect()
    assert [(r.text, r.n_words, r.n_removed, r.ord, r.starts, r.row) for r in got] == [("a b c d", 4, 0, 1, "x", {"k": 1}), ("z q", 6, 4, 1, "x", {"k": 1})]


def test_rolled_and_least():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 80).astype(np.uint64)
    for n in (1, 2, 3, 16, 50, 80):
        want = [0] * (81 - n)
        for k in range(81 - n):
            for v in values[k : k + n].tolist():
                want[k] = (want[k] * int(ss.BASE) + v) % 2**64
        assert ss.rolled(values, n).tolist() == want
        small = values % np.uint64(7)
        assert ss.least_at(small, n).tolist() == [k + int(np.argmin(small[k : k + n])) for k in range(81 - n)]
