"""Tables between the steps of a query, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a few numbers that one file holds with ease.
FILE_ROWS = 200_000
#: Spark's setting that deletes a query's shuffle files when the query ends, not when the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def _own(spark: SparkSession) -> str:
    """How this application's tables in the shared folder begin."""
    return f"factloom-{spark.sparkContext.applicationId}-"


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage ends there, and a lost executor costs nothing before it. The shuffle files that made it are let go.

    rows: about how many short rows there are, if that is known; a small table then becomes few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // FILE_ROWS + 1))
    path = f"{shared_dir(spark)}/{_own(spark)}{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def collected(spark: SparkSession) -> None:
    """Has the driver collect its garbage. Spark lets go broadcasts, shuffle state and generated classes of ended queries only then, and a driver that runs many short queries otherwise first fills its heap."""
    spark._jvm.System.gc()


def forget_written(spark: SparkSession) -> int:
    """Deletes every table that written() of this application has left in the shared folder; their number. For the end of a session: results that still read them are lost."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().startswith(_own(spark))]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
