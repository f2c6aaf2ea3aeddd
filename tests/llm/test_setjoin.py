import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import setjoin

from .texts import AWKWARD, documents


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    """{id: (size, least id reachable)}"""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        what = rng.random()
        if what < 0.6:
            words[at] = f"e{rng.randrange(10**6)}"
        elif what < 0.8:
            words.insert(at, f"e{rng.randrange(10**6)}")
        elif len(words) > 5:
            del words[at]
    return words


def corpus(rng, groups=6, copies=30):
    """Groups of near copies about the threshold, chains, texts that share a passage, and texts of their own."""
    out = list(AWKWARD[:9]) + ["word " * 300]
    passage = [f"p{k}" for k in range(60)]
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.randrange(2, copies)):
            out.append(" ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))))
        if g % 2:
            for _ in range(8):
                base = edited(rng, base, max(1, len(base) // 60))
                out.append(" ".join(base).upper())
    for _ in range(copies):
        out.append(" ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(12))] + passage))
        out.append(" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 50))))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"rounds": 0, "list_rows": 7}), (3, {"rounds": 1, "list_rows": 16})])
def test_brute_force(spark, seed, how):
    texts = corpus(random.Random(seed))
    docs = documents(spark, texts, first=100).withColumn("sid", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    got = setjoin.link_components(docs, **how)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute([(100 + k, t) for k, t in enumerate(texts)])
    assert len({c for _, c in want.values()}) < len(texts) - 20
    rows = got.collect()
    assert len(rows) == len(texts) and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_derived_answers_are_right():
    """Links and refusals that follow from a common leader agree with the sets themselves."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 120, dtype=np.uint64))
    sets = [base] + [np.unique(np.concatenate([rng.permutation(base)[: 120 - int(rng.integers(0, 18))], rng.integers(0, 2**63, int(rng.integers(0, 18)), dtype=np.uint64)])) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    overlap = np.array([len(np.intersect1d(s, base)) for s in sets])
    zero = np.zeros(61, np.int64)
    columns = {"token": zero, "low": zero, "high": zero, "side": zero, "sid": np.arange(61), "n": n, "at": zero, "root": np.arange(61), "hub": zero, "overlap": overlap, "n_hub": zero + len(base)}
    got = setjoin.pairs_of(columns, [setjoin.parity(s) for s in sets], 17, 20, False)
    few = setjoin.pairs_of(columns, [setjoin.parity(s) for s in sets], 17, 20, False, few=100)
    assert sorted(map(tuple, few.to_numpy())) == sorted(map(tuple, got.to_numpy()))
    links = {(j, i) for i in range(61) for j in range(i + 1, 61) if 20 * len(np.intersect1d(sets[i], sets[j])) >= 17 * len(np.union1d(sets[i], sets[j]))}
    sure = {(u, v) for u, v, k in got.itertuples(index=False) if k}
    assert sure and sure <= links <= {(u, v) for u, v, _ in got.itertuples(index=False)}
    assert len(got) < 61 * 60 / 2 * 0.8


def test_parity_bitmaps():
    rng = np.random.default_rng(6)
    for n in (1, 63, 64, 65, 500):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 3 :], rng.integers(0, 2**63, n // 2, dtype=np.uint64)]))
        bits = [setjoin.parity(a), setjoin.parity(b)]
        d = setjoin.differing(bits, np.array([0]), np.array([1]))[0]
        assert d <= len(np.setxor1d(a, b)) and (d - len(a) - len(b)) % 2 == 0


def test_null_ids_repeated_rows_and_threshold(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = documents(spark, [text, text, text + " x", "a b", None], first=5)
    docs = docs.unionByName(docs.where("doc_id = 6")).unionByName(docs.where("doc_id in (7, 9)").withColumn("doc_id", F.lit(None).cast("long")))
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.link_components(docs).collect()), key=str)
    assert rows == sorted([(5, 37, 5), (6, 37, 5), (6, 37, 5), (7, 38, 5), (None, 38, 5), (8, 1, 8), (9, 0, 9), (None, 0, None)], key=str)
    exact = setjoin.link_components(docs, least=Fraction(1)).collect()
    assert {r.doc_id: r.component_id for r in exact if r.doc_id} == {5: 5, 6: 5, 7: 7, 8: 8, 9: 9}


@pytest.mark.parametrize("words", [1, 16, 1 << 18])
def test_texts_of_named_sets_are_not_moved(spark, words):
    rng = random.Random(words)
    sids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(400)] + [0, -1, 63, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(s, "text") for s in sids], "sid long, text string")
    named = set(rng.sample(sids, 40)) | set(sids[-5:])
    found = setjoin.perhaps(rows, spark.createDataFrame([(s,) for s in named], "sid long"), words)
    got = [r["sid"] for r in found.collect()]
    assert named <= set(got) and len(set(got)) == len(got) and found.columns == ["sid", "text"]
    assert words == 1 or len(got) <= 60 + 400 * 45 // (64 * words)  # others are few
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "LeftSemi" not in plan


def test_only_hopeless_pairs_go_before_their_texts(spark):
    rng = random.Random(3)
    sets = {0: np.unique(np.array([rng.getrandbits(64) for _ in range(200)], np.uint64))}
    for sid, kept in enumerate((200, 198, 190, 184, 170, 120, 0), 1):
        sets[sid] = np.unique(np.concatenate([sets[0][:kept], np.array([rng.getrandbits(64) for _ in range(200 - kept)], np.uint64)]))
    members = spark.createDataFrame([(s, len(x), bytearray(setjoin.parity(x))) for s, x in sets.items()], "sid long, n long, bits binary")
    pairs = [(a, b) for a in sets for b in sets if a > b]
    kept = {tuple(r) for r in setjoin.possible(spark.createDataFrame(pairs, "u long, v long"), members, 85, 100).collect()}
    like = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in pairs}
    assert all(pair in kept for pair, x in like.items() if x >= 0.85)
    assert (7, 0) not in kept and (6, 0) not in kept
