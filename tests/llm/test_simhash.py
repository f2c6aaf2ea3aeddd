import random

import numpy as np
import pyarrow as pa
import xxhash

from factloom.llm import simhash
from factloom.llm.words import xxh64

from .texts import AWKWARD, documents


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, budget=2):
    """{id: least id reachable}"""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and (a ^ b).bit_count() <= budget:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def test_xxh64_is_xxh64():
    rng = random.Random(0)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(70), 200]]
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    assert xxh64(data, ends - [len(p) for p in parts], ends, 42).tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_fingerprints(spark):
    rng = random.Random(1)
    texts = [*AWKWARD, *(" ".join(rng.choice(["the", "Of", "verylongwordindeed" * 2, "é", "\t"]) for _ in range(rng.randrange(40))) for _ in range(60))]
    assert simhash.simhashes([None if t is None else t.encode() for t in texts]).tolist() == [brute_fingerprint(t) for t in texts]
    rows = simhash.near_duplicates(documents(spark, texts)).collect()
    found = [(k, brute_fingerprint(t)) for k, t in enumerate(texts)]
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {k: (f"{f:016x}", c) for (k, f), c in zip(found, brute_components(found).values(), strict=True)}


def near(rng, n):
    """Fingerprints in chains and clouds of few differing bits, at the ends of the range too."""
    out = [0, (1 << 64) - 1, 1, 1 << 63]
    while len(out) < n:
        x = rng.choice(out) if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_links_and_components_against_all_pairs(spark):
    rng = random.Random(2)
    for n, capacity, step in ((300, 8, 3), (200, 1, 5), (150, 1000, 3)):
        found = list(enumerate(near(rng, n)))
        rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in found], "doc_id long, fp long")
        got = rows.join(simhash.classes(rows, capacity=capacity, step=step), "fp").collect()
        assert {r.doc_id: r.component_id for r in got} == brute_components(found)


def test_traversal_finds_each_link_once():
    rng = random.Random(3)
    values = np.unique(np.array(near(rng, 400), np.uint64))
    found = [(int(i), int(j)) for a, b in simhash.traverse(values, None, 0, 0, 2, most=50) for i, j in zip(a, b, strict=True)]
    assert sorted(found) == [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 2]
    assert len(set(found)) == len(found)


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(-40, 60)] + [(100, 101), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {k: -40 for k in range(-39, 61)} | {101: 100}


def test_components_of_few_edges_take_two_tables(spark, monkeypatch):
    made, written = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda *how: made.append(1) or written(*how))
    assert simhash.components(spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")).where("root = 0").count() == 40
    assert len(made) == 2


def test_components_by_several_tasks(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    root = {k: k for e in edges for k in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long").repartition(7), rows=20).collect()}
    assert got == {k: r for k, r in root.items() if k != r}
    u, v = np.array(edges).T
    few = list(simhash.spanned(most=5)(pa.RecordBatch.from_arrays([pa.array(u[k : k + 9]), pa.array(v[k : k + 9])], names=["u", "v"]) for k in range(0, len(u), 9)))
    assert len(few) == 1 and dict(zip(*(c.to_pylist() for c in few[0].columns), strict=True)) == got


def test_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
