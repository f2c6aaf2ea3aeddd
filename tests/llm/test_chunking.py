import hashlib
import random

import numpy as np
import pytest

from factloom.llm import chunking as ck

from .texts import AWKWARD, documents


def brute_boundaries(data):
    """Byte by byte, from the text of the docstring."""
    ends, at = [], 0
    while at < len(data):
        end = len(data)
        for i in range(at, len(data)):
            size = i + 1 - at
            h = sum(int(ck.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF
            bits = ck.HARD_BITS if size < ck.NORMAL else ck.EASY_BITS
            if (size >= ck.LEAST and h >> (32 - bits) == 0) or size == ck.MOST:
                end = i + 1
                break
        ends.append(end)
        at = end
    return ends


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_boundaries_against_brute_force():
    rng = random.Random(0)
    for data in [b"", b"a", b"ab" * 900, *(prose(rng, rng.randint(1, 200)).encode() for _ in range(30)), rng.randbytes(3000)]:
        assert ck.boundaries(data) == brute_boundaries(data)


def test_shift_resistance_and_likeness():
    rng = random.Random(1)
    text = prose(rng, 1500)
    a = ck.chunks(text.encode())
    assert ck.likeness(a, ck.chunks(("Some words before. " + text).encode())) > 0.95
    assert ck.likeness(a, ck.chunks(prose(rng, 1500).encode())) < 0.02
    assert ck.likeness(a, ck.chunks((prose(rng, 300) + text[: len(text) // 2]).encode())) == pytest.approx(0.5, abs=0.08)
    assert ck.parse(ck.fingerprint(a)) == a and 60 < np.mean(list(a.values())) < 160
    assert (ck.likeness({}, {}), ck.likeness(a, {}), ck.likeness({}, a)) == (1.0, 0.0, 0.0)


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_next_documents(spark, n):
    rng = random.Random(n)
    texts = [AWKWARD[k] if k < len(AWKWARD) else prose(rng, rng.randint(0, 90)) for k in rng.sample(range(max(n, 1)), n)]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in ck.compare_with_next(docs.withColumn("range", docs.lang)).collect()}
    assert set(got) == set(range(n))
    for k in range(n):
        text, following = texts[k] or "", texts[(k - 1) % n] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own, after, its = (ck.chunks(t.encode()) for t in (text, changed, following))
        assert (r.fingerprint, r.edited_fingerprint) == (ck.fingerprint(own), ck.fingerprint(after))
        assert (r.near_edited, r.near_next) == (ck.likeness(own, after), ck.likeness(own, its))


def test_fingerprints_and_repeated_ids(spark):
    docs = documents(spark, ["one text", "one text", None])
    got = [r.fingerprint for r in ck.fingerprints(docs).orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[2] == ""
    same = docs.selectExpr("cast(null as long) as doc_id", "text").union(docs.selectExpr("1L", "text"))
    assert ck.compare_with_next(same).count() == 6
