"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Each source's documents, in hashed order, form one cyclic stream of words that is cut into blocks of `block` words.
The mix is a sequence of slots of one block each. Slot i lies at the golden-ratio point frac(i * phi), and the cumulative
weights of the sources map that point to a source. The slots of a source are ranked, and the slot of rank r takes
block r of its source's stream: slots and blocks join on (source, rank). The stream wraps round, so a source that is
wanted more than once is repeated whole before any part of it is taken again. The last block stops at the target.

The schedule says where in the mix a document's words stand: `mix` gives each document's first slot and number of slots, and `mixed`
gives the rows in the order of the slots at which they begin. A source that got fewer slots than it has blocks would be an error, and is raised as one.

Points, bounds and ranks are whole numbers, so any engine finds the same. A hashed order is cut into as many ranges as the number of rows asks for, and running totals within a
source (or within its slots) are made of two parts: a running sum of the ranges' totals, and one within each range. So the most that one task sees of a source is a range, or one number for each of its ranges.

Defined cases: null text counts 0 words and is taken 0 times (first slot null); a null source is a source of its own, ordered last;
repeated rows are separate documents; ties in hash order are broken by the row's columns, and rows equal in id, source and text are interchangeable in `mix`;
in `mixed` their copies are counted together and made from the one whose further columns hash least; an empty table gives an empty mix; other columns do not matter and are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, collected, dropped, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: 1 / golden ratio, to 9 digits as a ratio of integers, so that points are exact in 64-bit arithmetic.
PHI_NUMERATOR, PHI_DENOMINATOR = 618_033_989, 1_000_000_000
CELLS = 4096


def size_of(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3) -> DataFrame:
    """(source, source_size) -> also weight, cap and target: shares of all words by weight, none above `most` times its size.

    Water-filling in closed form: in order of cap / weight, a source is full if the words left by the full ones
    before it, shared by weight, reach its cap. One row a source, so the windows see as many rows as there are sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(every, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))).withColumn(
        "cap", F.col("source_size") * F.lit(float(most))
    )
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest)).drop("level", "full")


def schedule(plan: DataFrame) -> DataFrame:
    """plan: (source_no, blocks), the blocks each source needs -> (source_no, rank, slot) of every slot that a block takes.

    A golden-ratio sequence of n points leaves an interval within a few points of its share, so each source gets
    a few blocks of margin, and the slots after its last block stay unused.
    """
    spark = plan.sparkSession
    need = plan.agg(F.sum("blocks"), F.count("*")).first()
    if not need[0]:
        return spark.createDataFrame([], "source_no int, rank long, slot long")
    margin = margin_of(need[0], need[1])
    slots = int(need[0] + margin * need[1])
    # A source has the points from `low` up to below `high`, in units of the denominator.
    want = F.col("blocks").cast("decimal(38,0)") + F.lit(margin)
    upto = F.sum(want).over(Window.orderBy("source_no"))
    bound = lambda part: F.expr("cast(%s * %d div %d as long)" % (part, PHI_DENOMINATOR, slots))
    span = plan.withColumn("upto", upto.cast("decimal(28,0)")).withColumn("wanted", want.cast("decimal(28,0)"))
    span = span.select("source_no", "blocks", bound("(upto - wanted)").alias("low"), bound("upto").alias("high"))
    cell = PHI_DENOMINATOR // CELLS + 1
    cells = span.where("low < high").withColumn("cell", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))))
    point = F.col("id") % PHI_DENOMINATOR * PHI_NUMERATOR % PHI_DENOMINATOR
    # Consecutive slots form a run; runs grow as the root of the slots, so that a run's rows and a source's runs stay few.
    run = max(1 << 12, math.isqrt(slots))
    points = spark.range(slots).select("id", point.alias("point"), F.expr(f"id div {run}").alias("run")).withColumn("cell", F.expr(f"point div {cell}"))
    dealt = points.join(cells, "cell").where("point >= low and point < high").select("source_no", "blocks", "run", "id")
    counts = dealt.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    sums = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_no", "run", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("from"))
    within = Window.partitionBy("source_no", "run").orderBy("id")
    ranked = dealt.withColumn("k", F.row_number().over(within) - 1).join(starts, ["source_no", "run"])
    return ranked.withColumn("rank", F.col("from") + F.col("k")).where("rank < blocks").select("source_no", "rank", F.col("id").alias("slot"))


def margin_of(blocks: int, sources: int) -> int:
    """Slots that each source gets over its blocks: for the discrepancy, and for bounds rounded to the denominator."""
    return 3 + math.ceil(math.log2(blocks + sources + 2)) + 2 * (blocks // PHI_DENOMINATOR)


def mix(docs: DataFrame, weights=WEIGHTS, most: float = 3, block: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and n_slots for each row of docs (doc_id, text, source).

    taken is the number of words that the mix takes from the document, repeats counted; it lies within
    `most` times its size. A source's taken words are its target, rounded down. n_slots counts a slot once for each copy of the document in it.
    """
    return placed_rows(docs, weights, most, block, seed).select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"), "n_slots")


def row_hashes(seed: int) -> tuple[Column, Column]:
    """Two 60-bit numbers, of the MD5 of id, seed, source and text, that tell the rows apart; the first gives their order in the streams. Any engine can work them out."""
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}|"), source, F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary"))
    part = lambda at, name: F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name)
    return part(1, "h"), part(16, "h2")


#: Rows that a range of a source's hashed order holds, about.
RANGE_ROWS = 1 << 14


def placed_rows(docs: DataFrame, weights, most: float, block: int, seed: int) -> DataFrame:
    """What mix needs, with the rows' hashes; slots: at which slot each copy of the document begins."""
    sized = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *row_hashes(seed)))
    bits = min(24, max(6, (sized.count() // RANGE_ROWS).bit_length()))
    rows = sized.withColumn("bucket", F.shiftrightunsigned("h", 60 - bits).cast("int"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    plan = written(
        targets(sources, weights, most)
        .withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("words", F.floor("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("words") / F.lit(block)).cast("long"))
    )
    sums = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(sums), F.lit(0)).alias("from"))
    facts = plan.select("source", "source_no", "source_size", "target", "words")
    starts = starts.join(facts, starts.source.eqNullSafe(facts.source)).drop(facts.source)
    within = Window.partitionBy("source", "bucket").orderBy("h", "h2", "doc_id", "size")
    placed = rows.withColumn("row", F.row_number().over(within)).withColumn(
        "ahead", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = placed.join(starts, placed.source.eqNullSafe(starts.source) & (placed.bucket == starts.bucket)).select(
        "doc_id", "h", "h2", "size", "source_no", placed.bucket, "row", (F.col("from") + F.col("ahead")).alias("start"), "source_size", "target", "words"
    )
    # Read twice below. As a table of numbers it also ends the plan: Spark plans anew after each exchange, and what the driver holds grows with the plan's length.
    placed = written(placed)
    dropped(sized)
    collected(docs.sparkSession)
    # The document's stretches of the repeated stream, up to the target, and the blocks that each touches.
    rounds = F.when((F.col("size") > 0) & (F.col("words") > F.col("start")), F.floor((F.col("words") - 1 - F.col("start")) / F.col("source_size")).cast("int")).otherwise(F.lit(-1))
    stretch = (
        placed.withColumn("rounds", rounds)
        .where("rounds >= 0")
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds"))))
        .withColumn("low", F.col("round") * F.col("source_size") + F.col("start"))
        .withColumn("high", F.least(F.col("low") + F.col("size"), F.col("words")))
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
        .select(
            "source_no", "bucket", "row", "round", "rank", (F.least("high", (F.col("rank") + 1) * block) - F.greatest("low", F.col("rank") * block)).alias("words_here")
        )
    )
    slots = schedule(plan.select("source_no", "blocks"))
    dealt = stretch.join(slots, ["source_no", "rank"], "left").withColumn("slot", F.coalesce("slot", F.raise_error(F.lit("the schedule leaves a block without a slot")).cast("long")))
    copy = dealt.groupBy("source_no", "bucket", "row", "round").agg(F.sum("words_here").alias("taken"), F.min("slot").alias("slot"), F.count("*").alias("n_slots"))
    # `most` + 1 copies at most.
    taken = copy.groupBy("source_no", "bucket", "row").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list("slot")).alias("slots"), F.sum("n_slots").alias("n_slots"))
    return placed.join(taken, ["source_no", "bucket", "row"], "left").select(
        "doc_id", "h", "h2", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots")
    )


def mixed(docs: DataFrame, weights=WEIGHTS, most: float = 3, block: int = 64, seed: int = 7, position: str | None = None) -> DataFrame:
    """The mix itself, in the order of its slots: docs' rows (doc_id, text, source and others), each as often as the mix takes it whole, and the last of a source cut to the words taken, joined by one space.

    n_chars, where docs has it, follows the text. position: name of a further column, the slot at which the row begins.
    """
    taken = placed_rows(docs, weights, most, block, seed).where("taken > 0")
    copies = F.transform("slots", lambda slot, k: F.struct(slot.alias("slot"), F.least("size", F.col("taken") - k * F.col("size")).cast("int").alias("words"), F.col("size").alias("of")))
    # Written, so that the schedule's shuffle files and its part of the plan are gone before texts are moved.
    each = written(taken.withColumn("copies", copies).groupBy("h", "h2").agg(F.flatten(F.collect_list("copies")).alias("copies")))
    collected(docs.sparkSession)
    h, h2 = row_hashes(seed)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", h, h2)
    once = rows.join(each, ["h", "h2"]).withColumn("n", F.row_number().over(Window.partitionBy("h", "h2").orderBy(F.xxhash64("row")))).where("n = 1")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("copy.words")), " ")
    out = once.withColumn("copy", F.explode("copies")).withColumn("text", F.when(F.col("copy.words") < F.col("copy.of"), cut).otherwise(F.col("text")))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    ordered = out.orderBy("copy.slot", "h", "h2")
    return ordered.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns], *([F.col("copy.slot").alias(position)] if position else []))
