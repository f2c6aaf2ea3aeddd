"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; of unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hash_embedding(rows: DataFrame, id_col: str, text_col: str, dimensions: int = 64) -> DataFrame:
    """id, embedding: counts of words by the first two bytes of their SHA-256, scaled to unit length. Counted with partial sums."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    place = F.conv(F.substring(F.sha2("word", 256), 1, 4), 16, 10).cast("int") % dimensions
    counts = rows.select(id_col, F.explode(words).alias("word")).select(id_col, place.alias("place")).groupBy(id_col, "place").agg(F.count("*").cast("double").alias("n"))
    maps = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.coalesce("norm", F.lit(1.0)))
    empty = F.create_map().cast("map<int,double>")
    return rows.select(id_col).distinct().join(maps, id_col, "left").withColumn("m", F.coalesce("m", empty)).select(id_col, dense.alias("embedding"))
