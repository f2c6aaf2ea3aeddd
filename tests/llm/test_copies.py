import random

import corpus_pipeline
import numpy as np
from factloom.llm import copies

from .texts import AWKWARD, documents


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """The numbers that stay: the least of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def variants(rng):
    """Texts, and copies of them with more and more words changed, at both sides of 0.8; chains of copies; a line that many share."""
    line = " ".join(f"licence{k}" for k in range(30))
    texts = []
    for base in range(8):
        words = [f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(rng.choice([6, 40, 120, 400]))]
        texts.append(" ".join(words))
        for edits in range(1, 9):
            if rng.random() < 0.5:
                words = list(words)
            for _ in range(edits * len(words) // 150 + (edits % 3 == 0)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [f"{line} {' '.join(f'own{k}x{n}' for n in range(25))}" for k in range(12)] + [line, line.upper(), line + " end"]
    return texts


def test_all_copies_from_0_8_on_and_no_others(spark):
    texts = variants(random.Random(3)) + AWKWARD
    want = brute(texts)
    docs = documents(spark, texts)
    got = corpus_pipeline.drop_near_duplicates(spark, docs.union(docs.limit(4)).repartition(5), "")
    assert got.columns == docs.columns
    rows = sorted(r.doc_id for r in got.collect())
    assert rows == sorted(want) and len(want) < len(texts) - 20
    assert sorted(r.doc_id for r in copies.deduplicate(docs).collect()) == rows


def test_no_documents(spark):
    assert copies.deduplicate(documents(spark, [])).count() == 0


def test_pairs_of_a_shared_passage_are_no_rows(spark, monkeypatch):
    """Texts of different components that meet on a passage, in an order of shingles that does not put it last: what their bitmaps rule out is not made into pairs."""
    passage, pairs, verified = " ".join(f"p{k}" for k in range(34)), [], copies.verified
    docs = documents(spark, [" ".join(f"own{n}x{k}" for k in range(20)) + " " + passage for n in range(80)])
    monkeypatch.setattr(copies, "frequent", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(copies, "verified", lambda found, *how: pairs.append(found.count()) or verified(found, *how))
    assert copies.deduplicate(docs, rounds=1).count() == 80
    assert sum(pairs[2:]) < 80  # all pairs: 3160


def test_entries_without_a_partner_meet_nothing(spark, monkeypatch):
    """Texts of one size that share a shingle which comes too late in them for any link: none of their entries is joined with bitmaps."""
    own = [[f"own{n}x{k}" for k in range(100)] for n in range(60)]
    late = next(w for w in (f"s{k} a b c d" for k in range(10**4)) if abs(float(next(copies.shingle_sets([w.encode()]))[0]) / 2**64 - 0.17) < 0.001)
    docs = documents(spark, [f"{' '.join(words)} {late}" for words in own])
    joined, tiled = [], copies.tiled
    monkeypatch.setattr(copies, "frequent", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(copies, "tiled", lambda entries, *how: ("bits" in entries.columns and joined.append(entries.count())) or tiled(entries, *how))
    assert copies.deduplicate(docs).count() == 60
    assert sum(joined) < 20  # all that share it in their first shingles: over 40, in each of two turns
