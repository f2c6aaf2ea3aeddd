"""Every corpus query over tables with nulls everywhere, repeated rows and columns of clashing names, and over empty tables."""

import pytest
from pyspark.sql import functions as F

from factloom.llm import queries
from factloom.llm.common import counted_join, dropped, forget_written, shared_dir, written

from .texts import AWKWARD, documents

CLASHING = ["size", "row", "starts", "fp", "digest", "range", "score", "keys", "key", "content", "pages", "bucket", "h", "ord", "host", "path", "ids", "slot", "cut", "_id", "term", "n_bytes", "evidence"]


def tables(spark, folder, empty):
    docs = documents(spark, [*AWKWARD, " ".join(f"w{k}" for k in range(120)), " ".join(f"w{k}" for k in range(120))])
    nulls = docs.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    docs = docs.union(docs.limit(4)).union(nulls).union(docs.limit(1).withColumn("source", F.lit(None).cast("string")))
    pages = spark.createDataFrame([(1, "http://a.com/en/", "x"), (1, "http://a.com/en/", "x"), (None, None, None), (2, "://", ""), (3, "http://www.example.com/en/?", None)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (None, 1, 1), (2, None, None), (999, 1, 1), (3, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame(
        [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.8, 0.1], 2), (3, None, 2), (4, [None, 1.0], 2), (None, [1.0, 1.0], 1), (5, [float("nan"), 1.0], 2), (6, [], 3), (8, [1.0], None)],
        "vec_id long, embedding array<float>, label int",
    )
    for name, df in (("documents", docs), ("pages", pages), ("labels", labels), ("embeddings", vectors)):
        extra = df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])
        (extra.limit(0) if empty else extra).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return docs.count(), pages.count()


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = str(tmp_path_factory.mktemp("full")), str(tmp_path_factory.mktemp("empty"))
    counts = tables(spark, full, False)
    tables(spark, empty, True)
    return full, empty, counts


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_awkward_and_empty_tables(spark, folders, name):
    full, empty, (n_docs, n_pages) = folders
    rows = queries.QUERIES[name](spark, full).collect()
    if name == "op2_packing":
        assert sum(r.start == 0 for r in rows) == n_docs
    elif name == "op13_hard_negatives":
        # The label of 0 becomes 2 (0 is divisible by 7), so 2 is its positive and 1 scores too much to be a negative.
        assert rows == []
    else:
        assert len(rows) == (n_pages if name == "op1_url_filter" else n_docs)
    assert queries.QUERIES[name](spark, empty).collect() == []


class Cluster:
    """A session of a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Cluster.conf)


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_counted_join(spark):
    rows = written(spark.range(2000).selectExpr("if(id % 3 = 0, -1, id) as k", "id"))
    one = written(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most")).where("k % 2 <> 0"))
    got = counted_join(rows, one, ["k"], 2000)
    assert sorted(map(tuple, got.collect())) == sorted((k, i, m) for k, i, m in rows.join(one, "k").select("k", "id", "most").collect())
    assert one.where("n * 8 * 4 > 2000").count() == 1
    dropped(rows)
    with pytest.raises(Exception):
        rows.collect()


def test_written_tables_can_be_cleared(spark):
    df = written(spark.range(5).toDF("x"))
    assert df.count() == 5 and written(spark.range(0).toDF("x")).count() == 0
    assert forget_written(spark) >= 2 and forget_written(spark) == 0
