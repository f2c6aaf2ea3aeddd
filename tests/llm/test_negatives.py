import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import negatives, queries

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=50, positives=5, negatives=3):
    """rows: (vec_id, vector, label), each id once."""
    points = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            points.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, x, label in points:
        if a % every:
            continue
        score = {i: sum(p * q for p, q in zip(x, y)) for i, y, _ in points}
        ranked = sorted(points, key=lambda p: (-score[p[0]], p[0]))
        for p in [p for p in ranked if p[2] == label and p[0] != a][:positives]:
            s = score[p[0]]
            near = [n for n in ranked if n[2] != label and 50 * s <= 100 * score[n[0]] <= 95 * s][:negatives]
            out += [(a, p[0], k + 1, n[0], s, score[n[0]]) for k, n in enumerate(near)]
    return sorted(out)


def vectors(rng, n, width=8):
    """Clouds, equal vectors, and vectors that take no part."""
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[rng.randrange(6)]
        v = [x + rng.gauss(0, 0.3) for x in c] if rng.random() < 0.7 else list(c)
        rows.append((i - 20, [float(F"{x:.3f}") for x in v], rng.randrange(10)))
    rows += [(n + 1, None, 1), (n + 2, [1.0] * (width - 1) + [None], 1), (n + 3, [float("nan")] * width, 2), (n + 4, [float("inf")] * width, 2), (n + 5, [1.0] * width, None), (None, [1.0] * width, 3), (n + 6, [1e30] * width, 3)]
    return rows


def test_brute_force(spark):
    rows = vectors(random.Random(1), 700)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("d", F.lit("x")).withColumn("cell", F.lit(1)).repartition(5)
    asked = queries.relabelled(df)
    want = brute([r for r in rows if r[1] is None or 1e30 not in r[1]])
    assert len(want) > 60
    for how in ({}, {"anchors_per_task": 3, "rows_per_task": 40, "least_pivots": 12}, {"least_pivots": 1, "most_pivots": 1}):
        got = negatives.mine(asked, F.col("vec_id") % 50 == 0, **how)
        assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == want


def test_bounds_leave_rows_out(spark):
    """Far clouds are not sent to each other's anchors."""
    rng = random.Random(2)
    rows = [(i, [(i % 4 == k) * 9.0 + rng.gauss(0, 0.05) for k in range(4)], i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    points = negatives.whole_vectors(df)
    cells = negatives.Cells(points, 8, 4.0e7, 4)
    import numpy as np

    m = len(cells.pivots)
    owned = negatives.assigned(points, cells, anchors=False).drop("d")
    sent = negatives.routed(owned, cells, np.full(m, 200.0), np.zeros(m), np.full(m, 200.0), own=True).select(F.sum(F.size("groups"))).first()[0]
    assert 400 <= sent < 400 * m / 2


def test_large_components_are_exact(spark):
    big = [(50, [3e6, 2e6], 1), (1, [2.5e6, 1.0], 1), (2, [1e6, 1e6], 1), (3, [1.5e6, 1e3], 2), (7, [1.7e6, 9.0], 4), (4, [-1.0, 2.0], 2)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in big]
    got = negatives.mine(queries.relabelled(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows) != []


def test_repeated_rows_short_vectors_and_no_anchor(spark):
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (8, [1.0], 2), (8, [1.0], 2), (9, [1.0, 0.5], 2), (3, [0.5, 0.5], 2), (4, [], 5)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 8)
    # 9 is the only positive (256 * 256); 0 scores as much, over 95 percent; 3 scores half of it.
    assert sorted(map(tuple, got.collect())) == []
    got = negatives.mine(spark.createDataFrame([*rows, (5, [0.6, 0.0], 7)], SCHEMA), F.col("vec_id") == 8)
    assert sorted(map(tuple, got.collect())) == [(8, 9, 1, 5, 65536, 256 * 153)]
    assert negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 77).collect() == []
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 77).collect() == []
