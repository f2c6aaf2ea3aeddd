"""Calls of models that may fail: in batches, within a time budget, with repeats and a second model; and a table of vectors so that no text is asked for twice."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..streaming.jobs import Snapshots

#: A client takes some texts and the seconds it may take, and gives an answer for each, None where it has none.
Client = Callable[[Sequence[str], float], Sequence]


def answers(texts: Sequence[str], clients: Sequence[tuple[str, Client]], budget_s: float, tries: int, first_share: float, pause_s: float, clock=time.monotonic, sleep=time.sleep) -> list[tuple]:
    """(answer, client's name, tries, error) of each text. The first client has `first_share` of the budget, the others the rest; what fails is asked for again after pause_s, 2 * pause_s, 4 * pause_s ..."""
    out: list[tuple] = [(None, None, 0, "not asked")] * len(texts)
    open_ = list(range(len(texts)))
    began = clock()
    for number, (name, client) in enumerate(clients):
        ends = began + (first_share * budget_s if number == 0 and len(clients) > 1 else budget_s)
        for turn in range(tries):
            left = ends - clock()
            if not open_ or left <= 0:
                break
            error, got = "no answer", [None] * len(open_)
            try:
                got = list(client([texts[k] for k in open_], left))
                if len(got) != len(open_):
                    error, got = f"{len(got)} answers for {len(open_)} texts", [None] * len(open_)
            except Exception as e:  # noqa: BLE001  whatever a client raises is that call's failure
                error = f"{type(e).__name__}: {e}"
            for k, answer in zip(open_, got, strict=True):
                out[k] = (answer, name, out[k][2] + 1, None if answer is not None else error)
            open_ = [k for k in open_ if out[k][0] is None]
            wait = pause_s * 2**turn
            if not open_ or turn + 1 == tries or clock() + wait >= ends:
                break
            sleep(wait)
    return out


def ask(
    rows: DataFrame,
    clients: Callable[[], Sequence[tuple[str, Client]]],
    answer_type: T.DataType | None = None,
    id_col: str = "window_id",
    text_col: str = "prompt",
    size: int = 16,
    budget_s: float = 60.0,
    tries: int = 3,
    first_share: float = 0.6,
    pause_s: float = 1.0,
) -> DataFrame:
    """id, answer, model, tries, error of each row: texts go out `size` at once; a failure is a row with its error, never a failed task.

    clients: makes the (name, client) pairs, once in each task; the first is the primary model, the others stand in for what it leaves. A null text is not asked. A task that is lost asks again, so write the result and
    ask for what is `unanswered` later.
    """
    answer_type = answer_type or T.StringType()
    kind, arrow = rows.schema[id_col].dataType.simpleString(), to_arrow_type(answer_type)

    def run(batches):
        ready = clients()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = part.column(1).to_pylist()
                asked = [k for k, t in enumerate(texts) if t is not None]
                out = [(None, None, 0, "no text")] * len(texts)
                for k, found in zip(asked, answers([texts[k] for k in asked], ready, budget_s, tries, first_share, pause_s), strict=True):
                    out[k] = found
                columns = [pa.array([o[n] for o in out], t) for n, t in enumerate((arrow, pa.string(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, "answer", "model", "tries", "error"])

    return rows.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, answer {answer_type.simpleString()}, model string, tries int, error string")


def unanswered(rows: DataFrame, done: DataFrame, id_col: str = "window_id") -> DataFrame:
    """Rows without an answer so far, failed ones among them."""
    return rows.join(done.where("answer is not null").select(id_col), id_col, "left_anti")


class VectorCache:
    """Vectors by (kind, SHA-256 of the text): those of queries and of documents are apart. A table in a folder, one snapshot a turn.

    most: how many vectors are kept. Those used longest ago go first, a whole turn at once; those of the last turn always stay.
    """

    VECTOR = T.ArrayType(T.FloatType())
    SCHEMA = "kind string, key string, embedding array<float>, used long"

    def __init__(self, spark: SparkSession, path: str, most: int = 10_000_000):
        self.spark, self.most = spark, most
        self.table = Snapshots(spark, path, lambda before, now: now)

    def read(self) -> DataFrame:
        held = self.table.read()
        return self.spark.createDataFrame([], self.SCHEMA) if held is None else held

    def embed(self, rows: DataFrame, clients: Callable[[], Sequence[tuple[str, Client]]], turn: int, **how) -> DataFrame:
        """id, kind, embedding of rows (id, kind, text); null where no model answered, which is not kept and so asked for again. Equal texts of a kind are asked for once. turn: a number that grows."""
        keyed = rows.withColumn("key", F.sha2("text", 256))
        held, wanted = self.read(), keyed.where("text is not null").select("kind", "key", "text").dropDuplicates(["kind", "key"])
        new = wanted.join(held.select("kind", "key"), ["kind", "key"], "left_anti").withColumn("id", F.struct("kind", "key"))
        made = ask(new.select(F.concat_ws("/", "kind", "key").alias("id"), "text"), clients, self.VECTOR, "id", "text", **how).where("answer is not null")
        made = made.select(F.regexp_extract("id", "^(?s)(.*)/", 1).alias("kind"), F.substring_index("id", "/", -1).alias("key"), F.col("answer").alias("embedding"), F.lit(turn).cast("long").alias("used"))
        used = held.join(wanted.select("kind", "key", F.lit(True).alias("again")), ["kind", "key"], "left").withColumn("used", F.when(F.col("again"), F.lit(turn).cast("long")).otherwise(F.col("used"))).drop("again")
        self.table(used.unionByName(made), turn)
        self._evict(turn)
        return keyed.join(self.read().select("kind", "key", "embedding"), ["kind", "key"], "left").select("id", "kind", "embedding")

    def _evict(self, turn: int) -> None:
        """A second snapshot without the oldest turns, if there are too many rows."""
        total, oldest = 0, None
        for r in self.read().groupBy("used").count().orderBy(F.desc("used")).collect():  # a row for each turn that is left
            total += r["count"]
            if total > self.most and r["used"] != turn:
                break
            oldest = r["used"]
        if oldest is not None and self.read().where(F.col("used") < oldest).limit(1).count():
            self.table(self.read().where(F.col("used") >= oldest), turn + 1)
