"""Tables that batches change by key: a batch reads and writes the buckets of its own keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import facts as fact_op


class Buckets:
    """A table in n buckets by a hash of its keys, in a folder that driver and executors share: epoch=E/bucket=B holds the bucket as of epoch E.

    A bucket's rows are those of its newest finished epoch; a write takes effect as a whole, with its _SUCCESS file. What an epoch reads is older than it, so an epoch that comes again writes the same once more.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], n: int = 256):
        self.spark, self.path, self.keys, self.n = spark, path, keys, n

    def of(self, *keys: Column | str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.n)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows; at most n numbers."""
        return sorted(r[0] for r in rows.select(self.of(*self.keys)).distinct().collect())

    def _newest(self, before: int | None) -> dict[int, tuple[int, str]]:
        """bucket -> (epoch, folder), of finished epochs under `before`."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        out: dict[int, tuple[int, str]] = {}
        names = lambda path: [s.getPath().getName() for s in fs.listStatus(hadoop(path))] if fs.exists(hadoop(path)) else []
        for epoch in sorted(int(x[6:]) for x in names(self.path) if x.startswith("epoch=")):
            inside = names(f"{self.path}/epoch={epoch}")
            if "_SUCCESS" in inside and (before is None or epoch < before):
                out |= {int(b[7:]): (epoch, f"{self.path}/epoch={epoch}/{b}") for b in inside if b.startswith("bucket=")}
        return out

    def read(self, wanted: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """Rows of the wanted buckets (None: all), as of the epochs under `before`; None if there are none yet."""
        found = [folder for bucket, (_, folder) in sorted(self._newest(before).items()) if wanted is None or bucket in wanted]
        return self.spark.read.parquet(*found).where("_row").drop("_row") if found else None

    def write(self, rows: DataFrame, wanted: list[int], epoch: int) -> None:
        """The wanted buckets hold `rows` from this epoch on. A bucket that has no rows left gets a mark in their place."""
        marks = self.spark.createDataFrame([(b,) for b in wanted], "bucket int").withColumn("_row", F.lit(False))
        whole = rows.withColumn("bucket", self.of(*self.keys)).withColumn("_row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/epoch={epoch}")

    def vacuum(self, keep: int) -> int:
        """Deletes bucket folders that newer epochs up to `keep` have replaced; how many."""
        newest = self._newest(keep + 1)
        hadoop, gone = self.spark._jvm.org.apache.hadoop.fs.Path, 0
        fs = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.globStatus(hadoop(f"{self.path}/epoch=*/bucket=*")) or []:
            bucket, epoch = int(s.getPath().getName()[7:]), int(s.getPath().getParent().getName()[6:])
            if bucket in newest and epoch < newest[bucket][0]:
                fs.delete(s.getPath(), True)
                gone += 1
        return gone


class ConflictState:
    """Facts with their conflict status, kept as batches of facts come: for foreachBatch(state), or by hand.

    Two tables: facts in buckets of their class (material and property), and the class of each id in buckets of ids. A batch reads the buckets of its ids, and of the classes that its facts have or had; there older facts
    get their status anew. `order` says which of a batch's facts of one id counts: the one of greatest value (ties: of the greatest row).
    """

    def __init__(self, spark: SparkSession, path: str, order: str | None = None, synonyms: dict | None = None, n: int = 256):
        self.facts = Buckets(spark, f"{path}/facts", ["material_key", "property_key"], n)
        self.ids = Buckets(spark, f"{path}/ids", ["id"], n)
        self.order, self.synonyms = order, synonyms

    def current(self) -> DataFrame | None:
        rows = self.facts.read()
        return None if rows is None else rows.drop(*self.facts.keys)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        columns, keys = batch.columns, self.facts.keys
        order = [F.col(self.order).desc()] if self.order else []
        newest = Window.partitionBy("id").orderBy(*order, F.struct(*sorted(columns)).desc())
        fresh = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        fresh = fact_op.conflict_keys(fresh, self.synonyms).select(*columns, *keys)
        id_buckets = self.ids.touched(fresh)
        if not id_buckets:
            return
        known = self.ids.read(id_buckets, epoch)
        classes = fresh.select(*keys)
        if known is not None:
            classes = classes.unionByName(known.join(fresh.select("id"), "id", "left_semi").select(*keys))
        buckets = self.facts.touched(classes)
        before = self.facts.read(buckets, epoch)
        rows = fresh
        if before is not None:
            rows = rows.unionByName(before.drop("status").join(fresh.select("id"), "id", "left_anti"), allowMissingColumns=True)
        marked = fact_op.mark_conflicts(rows.drop(*keys), self.synonyms)
        marked = fact_op.conflict_keys(marked, self.synonyms).select(*marked.columns, *keys)
        # The facts first: if the ids' write is lost, the epoch comes again and both are written from what is older.
        self.facts.write(marked, buckets, epoch)
        told = fresh.select("id", *keys)
        self.ids.write(told if known is None else told.unionByName(known.join(fresh.select("id"), "id", "left_anti").select("id", *keys)), id_buckets, epoch)
