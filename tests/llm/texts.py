"""Small tables with the awkward rows that every corpus operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def documents(spark, texts, sources=None, first=0):
    rows = [(first + k, t, "en", (sources or [f"s{k % 3}" for k in range(len(texts))])[k], None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", " \t\n", "a", "A b\u00a0c  d\x0be", "it's WE'LL 12 <|endoftext|> ÉCOLE é e\u0301", "the same text here", "the same text here", "x" * 5000, "word " * 9000, "\x00 nul \x1f\u2028 sep", "日本語 テキスト 🙂🙂"]
