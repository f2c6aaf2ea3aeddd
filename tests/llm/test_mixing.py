import collections

import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing

from .texts import AWKWARD, documents


def fill(sizes, weights):
    """Targets by the text of the contract: share by weight, cut at 3 times, share the excess anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = float(total)
    while open_ and left > 1e-9:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def check(spark, texts, sources, **kw):
    docs = documents(spark, texts, sources)
    rows = mixing.mix(docs, **kw).collect()
    assert len(rows) == len(texts)
    size = [len((t or "").encode().split()) for t in texts]
    of = collections.Counter()
    for s, n in zip(sources, size):
        of[s] += n
    want, took = fill(of, mixing.WEIGHTS), collections.Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], of[s])
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        took[s] += r.taken
    for s in of:
        assert took[s] == int(want[s] + 1e-6), (s, took[s], want[s])
    assert sorted(mixing.mix(docs.repartition(3), **kw).collect()) == sorted(rows)
    out = mixing.mixed(docs, position="at", **kw).collect()
    assert [r["at"] for r in out] == sorted(r["at"] for r in out)
    words = collections.Counter()
    for r in out:
        words[r.doc_id] += len(r.text.encode().split())
    assert words == collections.Counter({r.doc_id: r.taken for r in rows if r.taken})
    first = {}
    for r in out:
        first.setdefault(r.doc_id, r["at"])
    assert first == {r.doc_id: r.first_slot for r in rows if r.taken}


def test_targets_are_met(spark):
    check(spark, AWKWARD, [["a", "b", None, "Z"][k % 4] for k in range(len(AWKWARD))])
    check(spark, ["w " * (k % 17) for k in range(400)], [["big", "é", "m", None][min(3, k % 9)] for k in range(400)], block=8)
    check(spark, ["w " * 300, "v " * 2], ["large", "tiny"])


def test_documents_are_repeated_evenly(spark):
    texts = ["w " * (5 + k % 7) for k in range(300)]
    rows = mixing.mix(documents(spark, texts, ["a" if k < 60 else "b" for k in range(300)]), block=16).collect()
    for r in rows:
        rounds = r.target / r.source_size
        assert int(rounds) * r["size"] <= r.taken <= (int(rounds) + 1) * r["size"]


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark, [None, ""], ["a", None])).collect()] == [0, 0]


def test_schedule_interleaves(spark):
    plan = spark.createDataFrame([(1, 500), (2, 200), (3, 100)], "source_no int, blocks long")
    rows = mixing.schedule(plan).groupBy("source_no").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert {r.source_no: (r.n, r.d, r.m) for r in rows} == {1: (500, 500, 499), 2: (200, 200, 199), 3: (100, 100, 99)}


def brute_schedule(blocks):
    """Slot by slot: the golden-ratio point, the source whose part of the line holds it, and its next rank."""
    margin = mixing.margin_of(sum(blocks), len(blocks))
    slots, edges, upto = sum(blocks) + margin * len(blocks), [0], 0
    for n in blocks:
        upto += n + margin
        edges.append(upto * 10**9 // slots)
    ranks, out = [0] * len(blocks), []
    for i in range(slots):
        p = i * 618_033_989 % 10**9
        s = next(k for k in range(len(blocks)) if edges[k] <= p < edges[k + 1])
        if ranks[s] < blocks[s]:
            out.append((s + 1, ranks[s], i))
        ranks[s] += 1
    return out


def test_schedule_against_brute_force(spark):
    for blocks in ([1], [7, 0, 3], [500, 200, 100, 1], [9000, 4000]):
        plan = spark.createDataFrame([(k + 1, n) for k, n in enumerate(blocks)], "source_no int, blocks long")
        rows = mixing.schedule(plan).collect()
        assert sorted(tuple(r) for r in rows) == sorted(brute_schedule(blocks)) and len(rows) == sum(blocks)
        seen = collections.Counter()
        for s, _, i in sorted(brute_schedule(blocks), key=lambda x: x[2]):
            seen[s] += 1
            if i < 0.8 * sum(blocks):  # at every place in the mix a source's slots are near its share
                assert abs(seen[s] - (i + 1) * (blocks[s - 1] / sum(blocks))) < 40


def test_result_follows_the_schedule(spark, monkeypatch):
    """With slots dealt source by source the result is another one; with too few slots it is an error."""
    texts = ["w " * (20 + k % 30) for k in range(120)]
    docs = documents(spark, texts, ["a" if k % 3 else "b" for k in range(120)])
    order = [r.doc_id for r in mixing.mixed(docs).collect()]
    rows = sorted(mixing.mix(docs).collect())
    mixes = [texts and k % 3 == 0 for k in order]
    assert any(mixes[: len(mixes) // 3]) and any(mixes[-len(mixes) // 3 :]) and not all(mixes[: len(mixes) // 3])
    plain = lambda plan: plan.select("source_no", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("rank")).withColumn("slot", F.col("source_no") * 10**6 + F.col("rank"))
    monkeypatch.setattr(mixing, "schedule", plain)
    assert sorted(mixing.mix(docs).collect()) != rows and [r.doc_id for r in mixing.mixed(docs).collect()] != order
    monkeypatch.setattr(mixing, "schedule", lambda plan: plain(plan).where("rank > 0"))
    with pytest.raises(Exception, match="without a slot"):
        mixing.mix(docs).collect()


def test_many_ranges_give_the_same(spark, monkeypatch):
    docs = documents(spark, ["w " * (k % 40) for k in range(500)])
    rows = sorted(mixing.mix(docs).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert sorted(mixing.mix(docs).collect(), key=lambda r: r.doc_id) == rows


def test_rows_equal_but_for_their_source_are_two(spark):
    docs = documents(spark, ["one two three"] * 3, ["a", "b", None]).withColumn("doc_id", F.lit(5).cast("long"))
    assert {r.source for r in mixing.mixed(docs).collect()} <= {"a", "b", None} and mixing.mixed(docs).count() >= 2


def test_no_plan_holds_the_whole_mix(spark):
    """What the driver holds while it plans anew after each exchange grows with a plan's exchanges: the schedule, the rows' places and the texts are three plans."""
    docs = spark.createDataFrame([(i, "a b c d", "xyz"[i % 3]) for i in range(30)], "doc_id long, text string, source string")

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    assert exchanges(mixing.mixed(docs)) <= 5
    assert exchanges(mixing.mix(docs)) <= 14
