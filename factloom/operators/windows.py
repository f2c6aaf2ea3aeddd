"""Windows: runs of fragments that go to extraction together, and what comes back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def text_windows(fragments: DataFrame, most: int = 2500, batch: int | None = None) -> DataFrame:
    """fragments (document_id, ordinal, element_type, section, page, text) -> document_id, window_no, first, last, n, text.

    A window ends where element type, section or, for paged formats, page changes, or where the next fragment would make it longer than `most`
    characters. With `batch`, no window spans two batches of so many fragments. One fold over each document's ordered fragments; documents are parallel.
    """
    body = fragments.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    key = F.concat_ws("\u0001", "element_type", F.coalesce("section", F.lit("")), F.when(F.col("element_type").rlike("^(pdf|pptx)"), F.coalesce(F.col("page").cast("string"), F.lit("")).cast("string")).otherwise(""))
    if batch:
        key = F.concat_ws("\u0001", key, F.floor((F.col("ordinal") - 1) / batch).cast("string"))
    rows = body.select("document_id", F.struct("ordinal", key.alias("key"), F.length(F.trim("text")).alias("size"), F.trim("text").alias("text")).alias("f"))
    lists = rows.groupBy("document_id").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    state = F.struct(F.lit(0).alias("no"), F.lit("").alias("key"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("of"))

    def step(s: Column, f: Column) -> Column:
        cut = (s["size"] > 0) & ((s["key"] != f["key"]) | (s["size"] + f["size"] > most))
        no = F.when(cut, s["no"] + 1).otherwise(s["no"])
        return F.struct(no.alias("no"), f["key"].alias("key"), F.when(cut, f["size"]).otherwise(s["size"] + f["size"]).alias("size"), F.concat(s["of"], F.array(no)).alias("of"))

    numbered = lists.select("document_id", F.explode(F.arrays_zip("fs", F.aggregate("fs", state, step)["of"].alias("no"))).alias("x"))
    flat = numbered.select("document_id", F.col("x.fs").alias("f"), F.col("x.no").alias("window_no"))
    grouped = flat.groupBy("document_id", "window_no").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    ordinals = F.transform("fs", lambda f: f["ordinal"])
    return grouped.select("document_id", "window_no", F.array_min(ordinals).alias("first"), F.array_max(ordinals).alias("last"), F.size("fs").alias("n"), F.array_join(F.transform("fs", lambda f: f["text"]), "\n").alias("text"))


def table_windows(rows: DataFrame, layout_chars: int = 200) -> DataFrame:
    """Table rows (document_id, table, row, text) -> one window a table, rows in order; tables without a digit under `layout_chars` characters are layout and go."""
    tables = rows.groupBy("document_id", "table").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("rs"))
    text = F.array_join(F.transform("rs", lambda r: r["text"]), " ")
    return tables.where(text.rlike(r"\d") | (F.length(text) >= layout_chars)).select("document_id", "table", F.size("rs").alias("n"), text.alias("text"))


def attribute_quote(windows: DataFrame) -> DataFrame:
    """windows (id, quote, fragments: array<struct<fragment_id, text>>) -> id, fragment_id the quotation is from.

    The first fragment that holds it; else the one that shares most of its words; else, and without a quotation, the first.
    """
    quote = tx.quote_key(F.col("quote"))
    words = F.array_distinct(F.split(quote, " "))
    holds = F.get(F.filter("fragments", lambda f: F.contains(tx.quote_key(f["text"]), quote)), F.lit(0))
    shared = lambda f: F.size(F.array_intersect(words, F.split(tx.quote_key(f["text"]), " ")))
    scored = F.transform("fragments", lambda f, i: F.struct(shared(f).alias("n"), (-i).alias("at"), f["fragment_id"].alias("fragment_id")))
    best = F.array_max(scored)
    lead = F.get("fragments", F.lit(0))["fragment_id"]
    return windows.select("id", F.when(quote == "", lead).when(holds.isNotNull(), holds["fragment_id"]).when(best["n"] > 0, best["fragment_id"]).otherwise(lead).alias("fragment_id"))
