"""Structured Streaming: files as they land, jobs as they change, facts as they arrive, answers as they are written."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import facts as fact_op


def landed_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of the files that land in a folder: checksum, path, content, seen_at."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return files.select(F.sha2("content", 256).alias("checksum"), "path", "content", F.col("modificationTime").alias("seen_at"))


def once(files: DataFrame, late: str | None = "30 days") -> DataFrame:
    """Each content once. With `late`, state older than that is let go; without, it is kept for good."""
    if late is None:
        return files.dropDuplicates(["checksum"])
    return files.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["checksum"])


def status_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Job events (ts, status) counted by window and status, closed when the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n")).select("window.start", "status", "n")


class Snapshots:
    """A keyed table kept as whole Parquet snapshots: merge(batch, epoch) writes the next one, and an epoch that comes again is not merged twice."""

    def __init__(self, spark: SparkSession, path: str, merge):
        self.spark, self.path, self.merge = spark, path, merge

    def _epochs(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("epoch=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[6:]) for n in done)

    def read(self) -> DataFrame | None:
        epochs = self._epochs()
        return self.spark.read.parquet(f"{self.path}/epoch={epochs[-1]}") if epochs else None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        epochs = [e for e in self._epochs() if e < epoch]
        before = self.spark.read.parquet(f"{self.path}/epoch={epochs[-1]}") if epochs else None
        self.merge(before, batch).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")


def merge_status(before: DataFrame | None, events: DataFrame) -> DataFrame:
    """The latest (ts, event_id) of each job."""
    rows = events.select("job_id", "status", "ts", "event_id")
    rows = rows if before is None else before.select(rows.columns).unionByName(rows)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id")).alias("x")).select("job_id", "x.*")


def merge_facts(before: DataFrame | None, facts: DataFrame) -> DataFrame:
    """Facts so far, the newer of equal ids, with their conflict status anew: a batch can make older facts conflicting."""
    rows = facts.withColumn("_new", F.lit(1)).drop("status")
    if before is not None:
        rows = rows.unionByName(before.drop("status").withColumn("_new", F.lit(0)))
    latest = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("_new").desc()))).where("_n = 1").drop("_n", "_new")
    return fact_op.mark_conflicts(latest)


# -- a value out of JSON that arrives in pieces --------------------------------------------------------------------

ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}


def feed(state: tuple[str, str], chunk: str, key: str) -> tuple[tuple[str, str], str]:
    """Takes a chunk of a JSON object's text; returns the state and what it adds to the string under `key`.

    State: (phase, text held back). Phases: seek (the key is not yet seen), value (inside the string), done. What may be the start of the key,
    of an escape or of half a surrogate pair is held back until more comes.
    """
    phase, text = state[0], state[1] + chunk
    if phase == "seek":
        mark = f'"{key}"'
        at = text.find(mark)
        rest = text[at + len(mark) :].lstrip() if at >= 0 else ""
        if at < 0 or not rest or (rest[0] == ":" and not rest[1:].lstrip()):
            return ("seek", text if at >= 0 else text[-len(mark) :]), ""
        if rest[0] != ":" or rest[1:].lstrip()[0] != '"':
            return ("seek", rest), ""
        phase, text = "value", rest[1:].lstrip()[1:]
    out, at = [], 0
    while phase == "value" and at < len(text):
        c = text[at]
        if c == '"':
            phase = "done"
        elif c != "\\":
            out.append(c)
            at += 1
        elif at + 1 >= len(text):
            break
        elif text[at + 1] != "u":
            out.append(ESCAPES.get(text[at + 1], text[at + 1]))
            at += 2
        elif at + 6 > len(text):
            break
        else:
            try:
                code = int(text[at + 2 : at + 6], 16)
            except ValueError:
                code = 0xFFFD
            width = 6
            if 0xD800 <= code < 0xDC00:
                if at + 12 > len(text) and text[at + 6 : at + 8] in ("", "\\", "\\u"):
                    break
                try:
                    low = int(text[at + 8 : at + 12], 16) if text[at + 6 : at + 8] == "\\u" else 0
                except ValueError:
                    low = 0
                code, width = (0x10000 + (code - 0xD800 << 10) + (low - 0xDC00), 12) if 0xDC00 <= low < 0xE000 else (0xFFFD, 6)
            elif 0xDC00 <= code < 0xE000:
                code = 0xFFFD
            out.append(chr(code))
            at += width
    return (phase, "" if phase == "done" else text[at:]), "".join(out)


def string_deltas(chunks: DataFrame, key: str = "summary") -> DataFrame:
    """A stream of (answer_id, seq, chunk) -> (answer_id, seq, delta): what each chunk adds to the string under `key`. Chunks of an answer come in order of seq."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("seek", "")
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, chunk in zip(rows["seq"], rows["chunk"], strict=True):
            now, delta = feed(tuple(now), chunk, key)
            if delta:
                out.append((group[0], seq, delta))
        state.update(now)
        yield pd.DataFrame(out, columns=["answer_id", "seq", "delta"])

    return chunks.groupBy("answer_id").applyInPandasWithState(run, "answer_id string, seq long, delta string", "phase string, held string", "append", GroupStateTimeout.NoTimeout)
