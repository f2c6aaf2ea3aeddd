"""Numeric conditions on candidates, and claims found over the parameters that a question names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantity import Quantities
from ..shared import written


def contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """text, needle: the pairs of a text and a needle that it contains. texts: text; needles: needle; neither repeats.

    A needle is looked up by its first three characters (all, if fewer) among the stretches of up to three characters of the texts: an equality join, whose pairs are then checked.
    """
    stretches = F.flatten(F.transform(F.sequence(F.lit(1), F.length("text")), lambda at: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring("text", at, n))))
    keys = F.when(F.length("text") > 0, F.array_distinct(F.concat(F.array(F.lit("")), stretches))).otherwise(F.array(F.lit("")))
    found = texts.select("text", F.explode(keys).alias("key")).join(needles.select("needle", F.substring("needle", 1, 3).alias("key")), "key")
    return found.where(F.contains("text", "needle")).select("text", "needle")


#: Bins of values: one for each power of two from 2^-20 to 2^62, and their negatives; 0 is for what is smaller.
LAST_BIN = 83


def value_bin(value: Column) -> Column:
    size = F.abs(value)
    step = F.floor(F.least(F.log2(F.greatest(size, F.lit(2.0**-20))), F.lit(float(LAST_BIN - 21)))).cast("int") + 21
    return F.when(size < 2.0**-20, 0).when(value < 0, -step).when(value.isNotNull(), step)


def _bins(low: Column, high: Column) -> list[Column]:
    """First and last bin of an interval; without an end, the outermost."""
    a, b = F.coalesce(value_bin(low), F.lit(-LAST_BIN)), F.coalesce(value_bin(high), F.lit(LAST_BIN))
    return [F.least(a, b).alias("first"), F.greatest(a, b).alias("last")]


def conditions_met(candidates: DataFrame, conditions: DataFrame, claims: DataFrame | None = None, hidden: DataFrame | None = None, quantities: Quantities | None = None) -> DataFrame:
    """question_id, condition_id, candidate_id, document_id, at: the parameters of approved, visible candidates that can meet a question's condition.

    candidates: candidate_id, status, document_id (null: no source), parameters: array<struct<name, value, value_min, value_max, unit>>; conditions: question_id, condition_id, parameter, value_min, value_max, unit;
    claims: (question_id, claim_id) that a question was led to: if any of a question's claims has a candidate, only such candidates count for it; hidden: document_id.

    A parameter fits if its name contains the condition's or is contained in it (case aside; nameless ones never do), and if its range meets the condition's in the condition's quantity. What has no numbers, or can't be
    converted, is compared as it is. Names meet by `contained`, each once; ranges meet in bins of powers of two, and a pair counts in the first bin that both have.
    """
    q = quantities or Quantities()
    value = lambda v, unit: F.coalesce(q.convert(v, unit, F.col("kind"), F.col("spec"), F.col("target"))["value"], v)
    wanted = conditions.withColumn("spec", q.spec(F.col("unit"))).withColumn("kind", F.col("spec.kind")).withColumn("target", q.target(F.col("kind"))).select(
        "question_id", "condition_id", F.lower("parameter").alias("parameter"), F.coalesce("kind", F.lit("")).alias("kind"),
        value(F.col("value_min"), F.col("unit")).alias("least"), value(F.col("value_max"), F.col("unit")).alias("most"),
    )
    pool = candidates.where("status = 'approved'")
    if hidden is not None:
        pool = pool.join(hidden.select("document_id"), "document_id", "left_anti")
    # Items are read for names, units and ranges: they are written once. So are the short tables of names and units; as their size is then known, items go to them without a shuffle.
    items = written(pool.select("candidate_id", "document_id", F.posexplode("parameters").alias("at", "p")).withColumn("name", F.lower("p.name")).where("trim(name) <> ''"))
    wanted = written(wanted)

    names, asked = items.select(F.col("name").alias("text")).distinct(), wanted.select(F.col("parameter").alias("needle")).distinct()
    either = contained(names, asked).select(F.col("text").alias("name"), F.col("needle").alias("parameter"))
    swap = contained(asked.select(F.col("needle").alias("text")), names.select(F.col("text").alias("needle"))).select(F.col("needle").alias("name"), F.col("text").alias("parameter"))
    named = written(either.unionByName(swap).distinct().join(wanted, "parameter"))

    # A parameter's range in the quantity of each condition on its name.
    low, high = F.coalesce("p.value_min", "p.value"), F.coalesce("p.value_max", "p.value")
    kinds = written(named.select("name", F.when(F.col("kind") != "", F.col("kind")).alias("kind")).distinct().withColumn("target", q.target(F.col("kind"))))
    units = written(items.select(F.col("p.unit").alias("unit")).distinct().withColumn("spec", q.spec(F.col("unit"))))
    ranged = items.withColumn("unit", F.col("p.unit")).join(kinds, "name").join(units.withColumnRenamed("unit", "_unit"), F.col("unit").eqNullSafe(F.col("_unit")))
    ranged = ranged.select("candidate_id", "document_id", "at", "name", F.coalesce("kind", F.lit("")).alias("kind"), value(low, F.col("unit")).alias("low"), value(high, F.col("unit")).alias("high"))
    ranged = ranged.select("*", *_bins(F.col("low"), F.col("high"))).withColumn("bin", F.explode(F.sequence("first", "last"))).withColumnRenamed("first", "first_item")
    bins = written(named.select("*", *_bins(F.col("least"), F.col("most"))).withColumn("bin", F.explode(F.sequence("first", "last"))).drop("parameter", "last"))
    met = ranged.join(bins, ["name", "kind", "bin"]).where(F.col("bin") == F.greatest("first", "first_item"))
    met = met.where(~F.coalesce(F.col("high") < F.col("least"), F.lit(False)) & ~F.coalesce(F.col("low") > F.col("most"), F.lit(False)))
    met = met.select("question_id", "condition_id", "candidate_id", "document_id", "at")
    if claims is None:
        return met
    met = written(met)
    mapped = claims.select("question_id", F.concat(F.lit("candidate-"), F.replace("claim_id", F.lit("claim-"), F.lit(""))).alias("candidate_id"))
    # What is met is a candidate's, so those among a question's claims need no look at the candidates.
    led = written(met.join(mapped, ["question_id", "candidate_id"], "left_semi").select(met.columns))
    # Only of questions with claims none of which is met it has to be seen whether any has a candidate.
    free = met.join(written(led.select("question_id").distinct()), "question_id", "left_anti").select(met.columns)
    asking = written(free.select("question_id").distinct())
    others = mapped.join(asking, "question_id", "left_semi").join(candidates.select("candidate_id"), "candidate_id", "left_semi").select("question_id").distinct()
    return led.unionByName(free.join(written(others), "question_id", "left_anti").select(met.columns))


#: Labels of the stored graph.
PARAMETERS = ("NumericParameter", "Condition")
OF_EXPERIMENT = ("measured_parameter", "operates_at_condition")


def parameter_claims(nodes: DataFrame, edges: DataFrame, asked: DataFrame, distinct: bool = True) -> DataFrame:
    """question_id, branch, claim_id: claims that mention a parameter or condition whose name contains what a question asks ('mention'), and claims based on an experiment that has it ('experiment'). Each once.

    nodes: id, label, name; edges: source, target, label; asked: question_id, parameter. The branches are apart, so a parameter that only one of them reaches loses nothing and none multiplies the other.
    distinct: whether each is there once, for readers that don't make them distinct themselves.
    """
    parameters = nodes.where(F.col("label").isin(*PARAMETERS)).select(F.col("id").alias("target"), F.lower("name").alias("text"))
    wanted = asked.select("question_id", F.lower("parameter").alias("needle"))
    found = contained(parameters.select("text").distinct(), wanted.select("needle").distinct()).join(wanted, "needle").select("question_id", "text").distinct()
    found = written(parameters.join(found, "text").select("question_id", "target"))
    into = edges.where(F.col("label").isin("MENTIONS", *OF_EXPERIMENT)).join(found, "target").select("question_id", "label", "source")
    into = into.distinct() if distinct else into
    kind = lambda label: nodes.where(F.col("label") == label).select(F.col("id").alias("source"))
    mention = into.where("label = 'MENTIONS'").join(kind("Claim"), "source", "left_semi").select("question_id", F.lit("mention").alias("branch"), F.col("source").alias("claim_id"))
    experiments = into.where("label <> 'MENTIONS'").select("question_id", "source").distinct().join(kind("Experiment"), "source", "left_semi").select("question_id", F.col("source").alias("target"))
    based = edges.where("label = 'BASED_ON'").join(experiments, "target").join(kind("Claim"), "source", "left_semi").select("question_id", F.lit("experiment").alias("branch"), F.col("source").alias("claim_id"))
    return mention.unionByName(based.distinct() if distinct else based)


def template_claims(*templates: DataFrame) -> DataFrame:
    """question_id, claim_id: what any of the templates (question_id, claim_id, ...) found, each once."""
    return reduce(DataFrame.unionByName, [t.select("question_id", "claim_id") for t in templates]).distinct()
