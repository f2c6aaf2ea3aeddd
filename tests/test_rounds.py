"""Operators that go in rounds over written tables: merged web results, reachable nodes."""

import random

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import graph, web

RESULTS = "question_id int, priority int, position int, title string, url string, snippet string"


def fold(rows, most, keys):
    """The plain fold: {question: [(title, url)]}."""
    out = {}
    for q, p, i, t, u, s in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or "", r[4] or "", r[5] or "")):
        us, ts, kept = out.setdefault(q, (set(), set(), []))
        ku, kt = keys[u or ""], keys[t or ""]
        if len(kept) < most and not (ku and ku in us) and not (kt and kt in ts):
            us.add(ku), ts.add(kt), kept.append((t or "", u or ""))
    return {q: kept for q, (_, _, kept) in out.items()}


def test_merge_equals_the_fold(spark):
    rng = random.Random(5)
    rows = []
    for q in range(6):
        for i in range(rng.choice([0, 3, 40, 200])):
            few = rng.random() < 0.8
            rows.append((q, rng.randint(0, 2), rng.randint(0, 60), rng.choice([None, "", *(f"T{rng.randint(0, 3 if few else 60)}" for _ in range(4))]), rng.choice([None, "", *(f"http://www.x{rng.randint(0, 3 if few else 60)}.org/" for _ in range(4))]), "s"))
    rows += [(9, 0, 0, "", None, "same")] * 30 + [(8, 0, k, "one title", f"http://a{k}.org", "") for k in range(100)] + [(8, 1, 0, "last", "http://z.org", "")]
    df = spark.createDataFrame(rows, RESULTS)
    values = spark.createDataFrame([(v,) for v in sorted({r[3] or "" for r in rows} | {r[4] or "" for r in rows})], "v string")
    keys = {r.v: r.k for r in values.select("v", F.when(F.col("v").startswith("http"), tx.normalize_url(F.col("v"))).otherwise(tx.normalize_text(F.col("v"))).alias("k")).collect()}
    for most, batch in ((12, 64), (12, 5), (3, 1), (12, 2)):
        got = {}
        for r in web.merge_results(df, most, batch).orderBy("question_id", "rank").collect():
            got.setdefault(r.question_id, []).append((r.title, r.url))
        assert got == fold(rows, most, keys)
    assert web.merge_results(df.limit(0)).count() == 0


def test_reachable_plan_does_not_grow(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(90)]
    edges = spark.createDataFrame([*pairs, (None, 1), (1, None)], "source int, target int").withColumn("label", F.lit("x"))
    start = spark.createDataFrame([(0,), (1,), (1,), (None,)], "id int")
    want, last = {0: 0, 1: 0}, {0, 1}
    for k in range(1, 5):
        last = {b for a, b in pairs if a in last} - set(want)
        want |= dict.fromkeys(last, k)
    found = graph.reachable(edges, start, 4)
    assert {r.id: r.hop for r in found.collect()} == want
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(found) <= 5
    assert graph.reachable(edges, start.limit(0), 4).count() == 0
    nodes = spark.createDataFrame([(i, "Claim" if i < 2 else "Material", "n") for i in range(61)], "id int, label string, name string")
    left = {r.id for r in graph.orphans(nodes, edges, 2).collect()}
    assert left == {i for i in range(2, 61) if want.get(i, 9) > 2}
