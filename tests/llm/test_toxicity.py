import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import toxicity as tx

from .texts import AWKWARD, documents


def random_index(rng, n, vocab, k=7):
    """An index of random examples, and their unit vectors in the index's order."""
    weights = np.array([rng.uniform(1, 5) for _ in range(vocab)])
    examples = []
    for i in range(n):
        terms = sorted(rng.sample(range(vocab), rng.randint(0, 6)))
        examples.append((np.array(terms, np.int64), np.array([rng.randint(1, 3) for _ in terms], np.int64), rng.randint(0, 1), i))
    index = tx.Index(weights, examples, 0.3, k, 1)
    kept = np.zeros((len(index.ids), vocab))
    for row, i in enumerate(index.ids):
        terms, unit = index.vector(*examples[i][:2])
        kept[row, terms] = unit
    return index, kept


@pytest.mark.parametrize("n, vocab", [(1, 30), (40, 30), (700, 30), (700, 3000), (3000, 40_000)])
def test_nearest_are_exact(n, vocab):
    """Dense and sparse lists, few and many blocks left; ties with the k-th are all there."""
    rng = random.Random(n)
    index, kept = random_index(rng, n, vocab)
    for _ in range(60):
        terms = np.array(sorted(rng.sample(range(vocab), rng.randint(1, 8))), np.int64)
        counts = np.array([rng.randint(1, 4) for _ in terms], np.int64)
        cosine = kept[:, terms] @ index.vector(terms, counts)[1]
        found, got = index.nearest(terms, counts)
        last = sorted(cosine)[-7] if len(cosine) >= 7 else 0
        want = {i for i, c in enumerate(cosine) if c > 0 and c >= last - 1e-6}
        assert set(found.tolist()) <= want and len(found) >= min(7, (cosine > 0).sum())
        assert np.allclose(got, cosine[found], atol=1e-6) and (np.diff(got) <= 0).all()
        assert {i for i in want if cosine[i] > last + 1e-6} <= set(found.tolist())


def brute_scores(rows, labels, digest_of, k=15, prior=1.0, shrink=8, floor=0.01):
    """Scores of (id, text, ...) rows by the whole method, all pairs, in plain Python: one text an id. digest_of: text -> the hash that orders the examples."""
    texts = {r[0]: r[1] or "" for r in rows}
    known = {}
    for i, y in labels:
        if i in texts and y is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = max(y, known.get(i, 0))
    counts = {t: tx.counted(t) for t in set(texts.values())}
    single = {(frozenset(counts[texts[i]]), y): i for i, y in sorted(known.items(), reverse=True)}
    examples = [(i, y) for (_, y), i in single.items()]
    examples.sort(key=lambda e: (digest_of[texts[e[0]]], e[0]))
    df = Counter(t for r in rows for t in set(counts[r[1] or ""]))

    def shares(examples, asked):
        base = sum(y for _, y in examples) / len(examples) if examples else 0.0
        n, toxic = Counter(), Counter()
        for i, y in examples:
            n.update(set(counts[texts[i]]))
            toxic.update(set(counts[texts[i]]) if y else ())

        def weight(t):
            gain = floor
            if 0 < base < 1:
                p = (toxic[t] + shrink * base) / (n[t] + shrink)
                gain += p * math.log(p / base) + (1 - p) * math.log((1 - p) / (1 - base))
            return (math.log((len(rows) + 1) / (df[t] + 1)) + 1) * gain

        def vector(text):
            v = {t: (1 + math.log(c)) * weight(t) for t, c in counts[text].items() if t in n}
            length = math.sqrt(sum(x * x for x in v.values()))
            return {t: x / length for t, x in v.items()}

        vectors = {i: vector(texts[i]) for i, _ in examples}
        bare = [y for i, y in examples if not vectors[i]]
        bare = (sum(bare) + prior * base) / (len(bare) + prior) if examples else 0.0
        out = []
        for text in asked:
            v = vector(text)
            near = [(sum(x * vectors[i].get(t, 0) for t, x in v.items()), y) for i, y in examples]
            near = sorted((c for c in near if c[0] > 1e-15), reverse=True)
            near = [c for c in near if len(near) < k or c[0] >= near[k - 1][0] - 1e-9]
            votes = [1 / (max(0.0, 1 - c) + 0.1) for c, _ in near]
            out.append((sum(v * y for v, (_, y) in zip(votes, near)) + prior * base) / (sum(votes) + prior) if near else bare)
        return out

    own = []
    for part in range(4):
        mine = examples[part::4]
        own += zip(shares([e for i, e in enumerate(examples) if i % 4 != part], [texts[i] for i, _ in mine]), [y for _, y in mine])
    out, own = {}, sorted(own)
    size, bins = max(4, min(32, len(own) // 40)), {}
    for at, (s, y) in enumerate(own):
        # A bin begins where the share of its first row begins.
        edges = sorted({next(i for i, o in enumerate(own) if o[0] == own[j][0]) for j in range(0, len(own), size)})
        bins.setdefault(max(e for e in edges if e <= at), []).append((s, y))
    groups = list(bins.values())
    mean = lambda a, b: sum(y for g in groups[a : b + 1] for _, y in g) / sum(len(g) for g in groups[a : b + 1])
    level = [max(min(mean(a, b) for b in range(i, len(groups))) for a in range(i + 1)) for i in range(len(groups))]
    knots = []
    for value in sorted(set(round(v, 12) for v in level)):
        flat = [r for g, v in zip(groups, level) if round(v, 12) == value for r in g]
        base = sum(y for _, y in own) / len(own)
        knots.append((sum(s for s, _ in flat) / len(flat), (sum(y for _, y in flat) + base) / (len(flat) + 1)))
    for i, s in zip(texts, shares(examples, list(texts.values()))):
        out[i] = float(np.interp(s, [x for x, _ in knots], np.maximum.accumulate([y for _, y in knots]))) if own else s
    return out


def digests(docs):
    return {r.text or "": r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}


def corpus(rng, n):
    bad = ["vile", "rotten", "awful"]
    texts, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 60))]
        y = rng.random() < 0.2
        if y:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(len(words)), rng.choice([w, w.upper() + "!"]))
        texts.append(" ".join(words))
        labels.append((k, int(y)))
    return texts, labels


def test_held_out_documents(spark):
    texts, labels = corpus(random.Random(0), 900)
    docs = documents(spark, [*texts, *AWKWARD]).withColumn("score", F.lit("own"))
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (10**6, 1)], "doc_id long, toxic int")
    rows = tx.score(docs, known).collect()
    assert len(rows) == len(texts) + len(AWKWARD) and {r.source for r in rows} == {"s0", "s1", "s2"}
    held = [r for r in rows if r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.predicted == labels[r.doc_id][1] == int(r.score >= 0.5) for r in held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(e.doc_id % 1 == 0 and zlib.crc32(str(e.doc_id).encode()) % 5 for r in rows for e in r.evidence or [])
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    flipped = known.withColumn("toxic", F.when(tx.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in tx.score(docs, flipped).collect()} == {r.doc_id: r.score for r in rows}


def test_scores_against_brute_force(spark):
    texts, labels = corpus(random.Random(1), 150)
    texts = [*texts, *texts[:5], *AWKWARD[:9], "vile", "zzz zzz"]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute_scores(rows, labels, digests(documents(spark, texts)))
    got = {r.doc_id: r.score for r in tx.score(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-5 for i in want), max((abs(got[i] - want[i]), i) for i in want)


def test_partitions_and_ids_do_not_matter(spark):
    """Equal scores with other shuffle widths, other partitions and other ids (of the same folds)."""
    texts, labels = corpus(random.Random(3), 300)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents(spark, texts)
    want = {r.text: r.score for r in tx.score(docs, known).collect()}
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert {r.text: r.score for r in tx.score(docs.repartition(3), known).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    free = {True: iter([i for i in range(9000, 1000, -1) if held(i)]), False: iter([i for i in range(9000, 1000, -1) if not held(i)])}
    new = {i: next(free[held(i)]) for i, _ in labels}
    renamed = spark.createDataFrame([(new[i], texts[i]) for i, _ in labels], "doc_id long, text string")
    assert {r.text: r.score for r in tx.score(renamed, spark.createDataFrame([(new[i], y) for i, y in labels], "doc_id long, toxic int")).collect()} == want


def test_scores_are_calibrated(spark):
    """Held-out rows: in each tenth of the scale, the share of toxic rows is near the mean score (noisy labels, so that scores spread)."""
    rng = random.Random(4)
    texts, labels = corpus(rng, 3000)
    labels = [(i, y if rng.random() < 0.85 else 1 - y) for i, y in labels]
    rows = tx.score(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    of = dict(labels)
    held = [(r.score, of[r.doc_id]) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    gap = 0.0
    for low in range(10):
        bin_ = [(s, y) for s, y in held if low <= 10 * s < low + 1 or (low == 9 and s == 1)]
        if bin_:
            gap += abs(sum(s for s, _ in bin_) - sum(y for _, y in bin_)) / len(held)
    assert gap < 0.06


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tx.score(documents(spark, AWKWARD), none).collect()} == {0.0}
    assert tx.score(documents(spark, []), none).count() == 0


def test_documents_that_share_one_word_count_each(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(6))
    texts = [f"commonword {word()} {word()} {word()} {'vile' if k % 5 == 0 else ''}" for k in range(300)]
    texts += texts[:50]
    labels = [(k, int(k % 300 % 5 == 0)) for k in range(350)]
    terms, index = tx.fit(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    fitted = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5]
    sets = {(frozenset(tx.terms_of(texts[k])), labels[k][1]) for k in fitted}
    assert index.base == sum(y for _, y in sets) / len(sets) and len(index.ids) == len(sets)
    assert set(terms) == {t for k in fitted for t in tx.counted(texts[k])}
    assert tx.family({"a", "b"}) == tx.family({"b", "a"}) != tx.family({"a", "c"})


def test_sample_and_character_bounds(spark):
    texts, labels = corpus(random.Random(6), 200)
    docs, known = documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert len(tx.fit(docs, known, sample=50)[1].ids) == 50
    few = tx.fit(docs, known, most_chars=2000)[1].ids
    assert 0 < len(few) and sum(len(texts[i]) for i in few) <= 2000


def test_one_overlong_example_leaves_the_others(spark):
    """A text over the character bound is no example; all others stay, wherever it stands in the order."""
    texts, labels = corpus(random.Random(6), 60)
    fitted = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5]
    bound = sum(len(texts[k]) for k in fitted)
    for k in fitted[:3]:
        changed = [*texts[:k], "long text " * bound, *texts[k + 1 :]]
        ids = tx.fit(documents(spark, changed), spark.createDataFrame(labels, "doc_id long, toxic int"), most_chars=bound)[1].ids
        assert k not in list(ids) and len(ids) >= len({texts[i] for i in fitted if i != k})
