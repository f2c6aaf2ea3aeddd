"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import FILE_ROWS, collected, dropped, forget_written, shared_dir, written  # noqa: F401

#: A word is a run of anything but ASCII white space; bytes.split() cuts UTF-8 at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counted_join(rows: DataFrame, one: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with `one`, which has a row for each key at most and in `n` the number of rows with that key; total: all rows.

    A key with over 1 / (8 * shuffle width) of all rows would burden one task: there are fewer than 8 * width of these, so their rows of `one` are broadcast, and rows with those keys are not moved.
    All other keys are joined by a shuffle. Both tables are read twice, so they should be written ones.
    """
    most = 8 * shuffle_width(rows.sparkSession)
    hot = F.broadcast(one.where(F.col("n") * most > total).drop("n"))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(one.where(F.col("n") * most <= total).drop("n"), keys))


def short(batches, rows: int = 256):
    """Arrow batches in slices of up to `rows` rows, so that a task holds the objects of few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions a shuffle gets in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(column):
    """A-Z to a-z, and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Memo(dict):
    """word -> value for the words seen of late. Two generations of at most `keep` entries each bound its memory, whatever the vocabulary."""

    def __init__(self, make, keep: int = 200_000):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value
