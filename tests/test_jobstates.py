import datetime as dt
import random

from pyspark.sql import functions as F

from factloom.operators import jobstates as op

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "job_id string, ts timestamp, event_id long, status string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def plain(events, now_min, patience_min):
    """The states one by one, from a job's sorted events."""
    jobs = {}
    for job, ts, event_id, status in {e for e in events if e[0] and e[1] and e[2] is not None and e[3] in op.STATES}:
        jobs.setdefault(job, []).append((ts, event_id, status))
    out = {}
    for job, seen in jobs.items():
        seen.sort()
        end = next((e for e in seen if e[2] in ("completed", "failed")), None)
        work = next((e for e in seen if e[2] == "processing"), None)
        queued = next((e for e in seen if e[2] == "queued"), None)
        status = end[2] if end else "processing" if work else "queued"
        issues = [] if queued and queued[:2] == seen[0][:2] else ["not_queued"]
        if end and (not work or work[:2] > end[:2]):
            issues.append("not_processed")
        if end and any(e[2] != end[2] and e[:2] > end[:2] for e in seen):
            issues.append("after_end")
        if not end and at(now_min) - seen[-1][0] > dt.timedelta(minutes=patience_min):
            status, issues = "failed", issues + ["timed_out"]
        out[job] = (status, (end or work or queued)[0], issues)
    return out


def made(rng, n):
    events = [(rng.choice([f"j{k}" for k in range(12)]), at(rng.randrange(100)), k, rng.choice([*op.STATES, "queued", "processing", "other"])) for k in range(n)]
    return events + events[:5]  # repeated ones


def got(df):
    return {r.job_id: (r.status, dt.datetime.fromtimestamp(r.since_us / 1e6, dt.UTC).replace(tzinfo=None), r.issues) for r in df.collect()}


def test_states_of_jobs(spark):
    events = [
        ("a", at(0), 1, "queued"), ("a", at(1), 2, "processing"), ("a", at(2), 3, "completed"),
        ("b", at(5), 4, "failed"), ("b", at(4), 5, "processing"), ("b", at(6), 6, "completed"),
        ("c", at(1), 7, "queued"), ("d", at(90), 8, "queued"), (None, at(1), 9, "queued"), ("e", None, 10, "queued"), ("f", at(3), 11, None), ("g", at(7), 12, "completed"),
    ]
    states = op.job_states(spark.createDataFrame(events, SCHEMA), F.lit(at(100)), 3600)
    assert {r.job_id: (r.status, r.issues) for r in states.collect()} == {
        "a": ("completed", []), "b": ("failed", ["not_queued", "after_end"]), "c": ("failed", ["timed_out"]), "d": ("queued", []), "g": ("completed", ["not_queued", "not_processed"]),
    }
    assert op.job_states(spark.createDataFrame([], SCHEMA), F.lit(at(0)), 1).count() == 0


def test_any_order_equals_one_by_one(spark):
    rng = random.Random(3)
    for n in (30, 60):
        events = made(rng, n)
        want = plain(events, 100, 40)
        rng.shuffle(events)
        assert got(op.job_states(spark.createDataFrame(events, SCHEMA), F.lit(at(100)), 40 * 60)) == want


def test_the_stream_equals_the_batch_and_gives_up_what_is_stuck(spark, tmp_path):
    rng = random.Random(4)
    events = made(rng, 50)
    rng.shuffle(events)
    path = f"{tmp_path}/in"
    for k in range(0, len(events), 20):
        spark.createDataFrame(events[k : k + 20], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    # Two late heralds of time: the first moves the watermark, the second lets the batch after it see it.
    for minutes, job in ((1000, "late1"), (1001, "late2")):
        spark.createDataFrame([(job, at(minutes), 1000 + minutes, "queued")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = op.job_state_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path), 40 * 60, "2 hours")
    latest = {}

    def keep(batch, epoch):
        latest.update(got(batch))

    q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    want = plain(events, 1000 - 120, 40)
    assert {j: s for j, s in latest.items() if not j.startswith("late")} == want
    assert any("timed_out" in s[2] for s in want.values())
