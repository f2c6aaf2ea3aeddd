"""The states of jobs: queued, processing, then completed or failed. One status for each job, in whatever order its events come and however often.

A job's events are kept as a summary: for each state its first and last event by (ts, event_id). Summaries merge by least and greatest, so a batch, a stream under any split, and a replay give the same one.

Status: completed or failed, whichever was reached first, since what has ended stays so; else processing, else queued. A job that has not ended and was not heard of for `patience` has failed, as timed out.
Issues name what the states do not allow: `not_queued` (an event before the first queued one, or none was), `not_processed` (an end without processing before it), `after_end` (an event of another state later than the end),
`timed_out`. Events of other states, or without job, time or event id, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = ("queued", "processing", "completed", "failed")
#: A summary's columns: micros and id of the first and of the last event of each state.
SEEN = [f"{state}_{end}_{part}" for state in STATES for end in ("first", "last") for part in ("us", "id")]


def _known(events: DataFrame) -> DataFrame:
    return events.where(F.col("status").isin(*STATES) & F.col("job_id").isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull())


def summaries(events: DataFrame) -> DataFrame:
    """events (job_id, ts, event_id: long, status) -> job_id and SEEN: one row a job, by partial aggregates."""
    at = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").cast("long").alias("id"))
    ends = {f"{state}_{end}": fold(F.when(F.col("status") == state, at)) for state in STATES for end, fold in (("first", F.min), ("last", F.max))}
    found = _known(events).groupBy("job_id").agg(*[c.alias(name) for name, c in ends.items()])
    return found.select("job_id", *[F.col(f"{name}.{part}").alias(f"{name}_{part}") for name in ends for part in ("us", "id")])


def resolved(seen: DataFrame, timed_out: Column) -> DataFrame:
    """Summaries -> job_id, status, since_us (when the status was reached), last_us (the last event) and issues. timed_out: whether a job that has not ended counts as given up."""
    at = lambda state, end: F.when(F.col(f"{state}_{end}_us").isNotNull(), F.struct(F.col(f"{state}_{end}_us").alias("us"), F.col(f"{state}_{end}_id").alias("id")))
    rows = seen.withColumn("_end", F.least(at("completed", "first"), at("failed", "first"))).withColumn("_first", F.least(*[at(s, "first") for s in STATES]))
    ended, working = F.col("_end").isNotNull(), F.col("processing_first_us").isNotNull()
    completed = F.coalesce(F.col("_end") == at("completed", "first"), F.lit(False))
    status = F.when(completed, "completed").when(ended, "failed").when(working, "processing").otherwise("queued")
    rows = rows.withColumn("_stuck", ~ended & timed_out).withColumn("_status", status)
    later = F.greatest(at("queued", "last"), at("processing", "last"), F.when(F.col("_status") == "failed", at("completed", "last")), F.when(F.col("_status") == "completed", at("failed", "last")))
    issues = {
        "not_queued": F.col("queued_first_us").isNull() | (F.col("_first") < at("queued", "first")),
        "not_processed": ended & F.coalesce(at("processing", "first") > F.col("_end"), F.lit(True)),
        "after_end": ended & (later > F.col("_end")),
        "timed_out": F.col("_stuck"),
    }
    last = F.greatest(*[F.col(f"{s}_last_us") for s in STATES])
    since = F.coalesce("_end.us", "processing_first_us", "queued_first_us")
    return rows.select(
        "job_id", F.when(F.col("_stuck"), "failed").otherwise(F.col("_status")).alias("status"), since.alias("since_us"), last.alias("last_us"),
        F.array_compact(F.array(*[F.when(test, name) for name, test in issues.items()])).alias("issues"),
    )


def job_states(events: DataFrame, now: Column, patience_s: int) -> DataFrame:
    """The state of each job at `now`, from all its events."""
    last = F.greatest(*[F.col(f"{s}_last_us") for s in STATES])
    return resolved(summaries(events), F.unix_micros(now.cast("timestamp")) - last > patience_s * 1_000_000)


def merged(seen: tuple, events: pd.DataFrame) -> tuple:
    """A summary (None: no such event) with the events (status, us, event_id) of its job."""
    out = list(seen)
    for status, us, event_id in zip(events["status"], events["us"].tolist(), events["event_id"].tolist(), strict=True):
        k = 4 * STATES.index(status)
        if out[k] is None or (us, event_id) < (out[k], out[k + 1]):
            out[k : k + 2] = us, event_id
        if out[k + 2] is None or (us, event_id) > (out[k + 2], out[k + 3]):
            out[k + 2 : k + 4] = us, event_id
    return tuple(out)


def job_state_stream(events: DataFrame, patience_s: int, late: str = "1 hour") -> DataFrame:
    """A stream of events -> the state of each job that a batch touches, and of each that the watermark finds not heard of for `patience_s`; for output mode update, the last row of a job counts.

    Keyed state holds a job's summary, 16 numbers, for good: what comes after the end is still told from a new job. An event that comes after its job timed out takes the job up again.
    """
    fields = ", ".join(f"{c} long" for c in SEEN)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = tuple(state.get) if state.exists else (None,) * len(SEEN)
        out_of_time = state.hasTimedOut
        if not out_of_time:
            for frame in frames:
                seen = merged(seen, frame)
            state.update(seen)
            ended = seen[8] is not None or seen[12] is not None
            if not ended:
                due = max(x for x in seen[2::4] if x is not None) // 1000 + patience_s * 1000
                out_of_time = due <= state.getCurrentWatermarkMs()
                if not out_of_time:
                    state.setTimeoutTimestamp(due)
        yield pd.DataFrame([(key[0], *seen, out_of_time)], columns=["job_id", *SEEN, "timed_out"]).astype(dict.fromkeys(SEEN, "Int64"))

    rows = _known(events).withWatermark("ts", late).select("job_id", "status", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"))
    seen = rows.groupBy("job_id").applyInPandasWithState(run, f"job_id string, {fields}, timed_out boolean", fields, "update", GroupStateTimeout.EventTimeTimeout)
    return resolved(seen, F.col("timed_out"))
