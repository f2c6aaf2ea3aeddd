import json
import random

from factloom.operators import facts as fact_op
from factloom.streaming import jobs, keyed


def test_a_string_split_anywhere():
    value = 'aБ"b\\ \n 🙂 é'
    for ascii_ in (True, False):
        text = json.dumps({"title": "x", "summary": value, "after": 1}, ensure_ascii=ascii_)
        rng = random.Random(0)
        for _ in range(200):
            cuts = sorted(rng.sample(range(len(text)), rng.randint(0, 6)))
            state, out = ("seek", ""), ""
            for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
                state, delta = jobs.feed(state, text[a:b], "summary")
                out += delta
            assert out == value and state[0] == "done"


def test_answers_as_they_are_written(spark, tmp_path):
    chunks = [("a", 0, '{"summary": "on'), ("a", 1, "e\\"), ("a", 2, 'ntwo"}'), ("b", 0, '{"x": 1, "summary": "z"')]
    for k, row in enumerate(chunks):
        spark.createDataFrame([row], "answer_id string, seq long, chunk string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        del k
    stream = spark.readStream.schema("answer_id string, seq long, chunk string").parquet(f"{tmp_path}/in")
    q = jobs.string_deltas(stream).writeStream.format("memory").queryName("deltas").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("deltas").orderBy("answer_id", "seq").collect()
    text = {}
    for r in rows:
        text[r.answer_id] = text.get(r.answer_id, "") + r.delta
    assert text == {"a": "one\ntwo", "b": "z"}


def test_files_are_taken_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.txt", "one"), ("b.txt", "two"), ("c.txt", "one")):
        (tmp_path / "in" / name).write_text(data)
    q = jobs.once(jobs.landed_files(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("files").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    (tmp_path / "in" / "d.txt").write_text("two")
    q.processAllAvailable()
    q.stop()
    assert sorted(bytes(r.content).decode() for r in spark.table("files").collect()) == ["one", "two"]


def test_latest_status_over_batches(spark, tmp_path):
    keep = jobs.Snapshots(spark, f"{tmp_path}/jobs", jobs.merge_status)
    schema = "job_id string, status string, ts long, event_id long"
    assert keep.read() is None
    keep(spark.createDataFrame([("j1", "queued", 1, 1), ("j2", "queued", 1, 2)], schema), 0)
    keep(spark.createDataFrame([("j1", "failed", 3, 4), ("j1", "processing", 2, 3)], schema), 1)
    keep(spark.createDataFrame([("j1", "failed", 3, 4), ("j1", "processing", 2, 3)], schema), 1)
    assert {r.job_id: r.status for r in keep.read().collect()} == {"j1": "failed", "j2": "queued"}


def test_conflicts_over_batches(spark, tmp_path):
    schema = "id string, material string, property string, effect_direction string"
    rows = [("1", "Cu", "p", "increase"), ("2", "cu ", "P", "рост"), ("3", "Cu", "p", "decrease"), ("4", "Ni", "p", "decrease"), ("3", "Cu", "p", "neutral")]
    keep = jobs.Snapshots(spark, f"{tmp_path}/facts", jobs.merge_facts)
    for k, row in enumerate(rows[:4]):
        keep(spark.createDataFrame([row], schema), k)
    assert {r.id: r.status for r in keep.read().collect()} == {"1": "conflicting", "2": "conflicting", "3": "conflicting", "4": "approved"}
    whole = fact_op.mark_conflicts(spark.createDataFrame(rows[:4], schema))
    assert {r.id: r.status for r in whole.collect()} == {r.id: r.status for r in keep.read().collect()}
    keep(spark.createDataFrame(rows[4:], schema), 4)
    assert {r.status for r in keep.read().collect()} == {"approved"}


def test_keyed_conflicts_equal_the_batch_under_any_split(spark, tmp_path):
    """Batches of several sizes, one epoch twice: the same as all facts at once; ids change their class and direction."""
    import random

    rng = random.Random(5)
    schema = "id string, material string, property string, effect_direction string, version long"
    rows = [(f"f{rng.randrange(25)}", rng.choice(["Cu", "cu ", "Ni", "Zn", None]), rng.choice(["p", "Q"]), rng.choice(["increase", "decrease", "neutral", "рост"]), v) for v in range(60)]
    latest = spark.createDataFrame(list({r[0]: r for r in rows}.values()), schema)
    want = sorted(map(tuple, fact_op.mark_conflicts(latest).collect()), key=str)
    for cuts in ([60], [7, 8, 30, 60]):
        state = keyed.ConflictState(spark, f"{tmp_path}/{len(cuts)}", order="version", n=8)
        assert state.current() is None
        for epoch, (a, b) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
            batch = spark.createDataFrame(rows[a:b], schema)
            for _ in range(2 if epoch == 1 else 1):
                state(batch, epoch)
        state(spark.createDataFrame([], schema), 9)
        assert sorted((tuple(r[c] for c in latest.columns + ["status"]) for r in state.current().collect()), key=str) == want
    assert state.facts.vacuum(9) > 0
    assert sorted((tuple(r[c] for c in latest.columns + ["status"]) for r in state.current().collect()), key=str) == want


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    schema = "id string, material string, property string, effect_direction string"
    state = keyed.ConflictState(spark, str(tmp_path), n=64)
    state(spark.createDataFrame([(f"f{k}", f"m{k}", "p", "increase") for k in range(200)], schema), 0)
    state(spark.createDataFrame([("new", "m7", "p", "decrease")], schema), 1)
    assert {r.id: r.status for r in state.current().where("status = 'conflicting'").collect()} == {"f7": "conflicting", "new": "conflicting"}
    assert sum(epoch == 1 for epoch, _ in state.facts._newest(None).values()) == 1
    assert state.current().count() == 201
