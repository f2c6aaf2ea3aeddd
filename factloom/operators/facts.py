"""Facts: visibility, filters, ranking, evidence, conflicts, contradictions, gaps.

A fact has id, document_id, fragment_id, material, process, property, lab, temperature_c, effect_direction, confidence, is_hypothesis.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import written
from . import opposed


def canonical_entity(value: Column, synonyms: dict | None = None) -> Column:
    """The name of an entity after the synonyms; unknown names as they are, trimmed."""
    if not synonyms:
        return F.trim(value)
    known = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.translate(tx.normalize_text(value), "ё", "е")), F.trim(value))


def entity_key(value: Column, synonyms: dict | None = None) -> Column:
    """What names are compared by; null for nothing."""
    return F.when(F.coalesce(value, F.lit("")) != "", tx.canonical(canonical_entity(value, synonyms)))


def visible(facts: DataFrame, hidden: DataFrame) -> DataFrame:
    """Facts whose document is not in `hidden` (document_id)."""
    return facts.join(hidden, "document_id", "left_anti")


def filtered(
    facts: DataFrame,
    confidence_min: float = 0.0,
    hypotheses: bool = False,
    material: str | None = None,
    property: str | None = None,  # noqa: A002
    materials: tuple[str, ...] = (),
    properties: tuple[str, ...] = (),
    labs: tuple[str, ...] = (),
    synonyms: dict | None = None,
) -> DataFrame:
    """Facts that meet all the given conditions; names are compared by their keys, laboratories as written."""
    key = lambda v: entity_key(F.lit(v), synonyms)
    keep = F.col("confidence") >= confidence_min
    if not hypotheses:
        keep &= ~F.col("is_hypothesis")
    for column, one, many in (("material", material, materials), ("property", property, properties)):
        wanted = [v for v in many if v]
        if one:
            keep &= entity_key(F.col(column), synonyms) == key(one)
        if wanted:
            keep &= F.array_contains(F.array(*map(key, wanted)), entity_key(F.col(column), synonyms))
    if labs:
        keep &= F.col("lab").isin(*labs)
    return facts.where(keep)


def in_years(facts: DataFrame, documents: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Facts of documents from these years; without a bound all, with one none of unknown year."""
    if first is None and last is None:
        return facts
    year = F.col("year")
    keep = (year >= first if first is not None else F.lit(True)) & (year <= last if last is not None else F.lit(True))
    return facts.join(documents.where(year.isNotNull() & keep).select("document_id"), "document_id", "left_semi")


def ranked(facts: DataFrame, material: str | None = None, property: str | None = None, process: str | None = None, synonyms: dict | None = None) -> DataFrame:  # noqa: A002
    """facts with rank_score: confidence, more where material, property or process agree with the question."""
    score = F.col("confidence")
    for column, value, gain in (("material", material, 0.3), ("property", property, 0.25)):
        if value:
            score += F.when(entity_key(F.col(column), synonyms) == entity_key(F.lit(value), synonyms), gain).otherwise(0.0)
    if process:
        score += F.when(F.contains(F.lower("process"), F.lower(F.lit(process))), 0.2).otherwise(0.0)
    return facts.withColumn("rank_score", score)


def first_of_each(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; a hot key costs one row a task before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    sort = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), sort).alias("row"))
    return best.select(*keys, "row.*").select(rows.columns)


def sources(facts: DataFrame, *order: Column) -> DataFrame:
    """The first fact of each (document, fragment)."""
    return first_of_each(facts, ["document_id", "fragment_id"], *order)


def mean_confidence(facts: DataFrame) -> DataFrame:
    """One row: the mean confidence to three places, 0 without facts."""
    return facts.agg(F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("confidence"))


def evidence_status(direct: Column, related: Column) -> Column:
    """direct, partial or none, from the numbers of direct and of related facts and hits."""
    return F.when(direct > 0, "direct").when(related > 0, "partial").otherwise("none")


def unique_facts(*lists: DataFrame) -> DataFrame:
    """Facts of several lists, each once, with the number of the first list it is in."""
    rows = None
    for k, facts in enumerate(lists):
        part = facts.withColumn("list_no", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    return first_of_each(rows, ["id"], F.col("list_no"))


def scientific_share(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: the share of facts from documents known to be scientific, to two places; null without facts."""
    known = facts.join(documents.select("document_id", "is_scientific"), "document_id", "left")
    return known.agg(F.round(F.avg(F.coalesce(F.col("is_scientific").cast("int"), F.lit(0))), 2).alias("scientific_share"))


def document_counts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """document_id, facts and experiments of every document."""
    counts = facts.groupBy("document_id").agg(F.count("*").alias("facts"), F.countDistinct("experiment_id").alias("experiments"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return documents.select("document_id").join(counts, "document_id", "left").select("document_id", zero("facts"), zero("experiments"))


def gaps(facts: DataFrame, target: str | None = None, numeric_evidence: DataFrame | None = None) -> DataFrame:
    """gap: what the evidence lacks; one row for each lack."""
    evidence = (numeric_evidence.limit(1) if numeric_evidence is not None else facts.limit(0)).agg(F.count("*").alias("numeric"))
    # One row on either side.
    counts = facts.agg(F.count("*").alias("facts"), F.countDistinct("lab").alias("labs")).withColumn("one", F.lit(1)).join(evidence.withColumn("one", F.lit(1)), "one")
    nothing = (F.col("facts") == 0) & (F.col("numeric") == 0)
    found = F.array(
        F.when(nothing, F.lit("Нет подтверждённых фактов для заданной комбинации условий.")),
        F.when(~nothing & (F.col("facts") > 0) & (F.col("labs") < 2), F.lit("Результаты подтверждены менее чем двумя независимыми источниками.")),
        F.when(~nothing & (F.col("numeric") == 0) & F.lit(bool(target)), F.lit(f"Нет данных, напрямую подтверждающих целевой показатель «{target}».")),
    )
    return counts.select(F.explode(F.array_compact(found)).alias("gap"))


def loose_search(facts: DataFrame, terms: list[str], synonyms: dict | None = None) -> DataFrame:
    """term, facts: for each loosened term, the facts whose material or process holds it. Facts are read once, the terms are literals."""
    names = F.array(*[F.struct(F.lit(t).alias("term"), F.lower(canonical_entity(F.lit(t), synonyms)).alias("name")) for t in terms])
    some = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lower(canonical_entity(F.lit(t), synonyms))) for t in terms for c in ("material", "process")], F.lit(False))
    hits = facts.where(some).withColumn("hit", F.explode(F.filter(names, lambda n: F.contains(F.lower("material"), n["name"]) | F.contains(F.lower("process"), n["name"]))))
    return hits.groupBy(F.col("hit.term").alias("term")).agg(F.count("*").alias("facts"))


def word_matches(facts: DataFrame, question_words: list[str], k: int | None = 30) -> DataFrame:
    """Facts with a word of material, process or property whose key is one of the question's, the k most confident (ties by id)."""
    keys = {w if len(w) <= 4 else w[:5] for w in question_words}
    words = tx.tokens(F.concat_ws(" ", "material", "process", "property"))
    found = facts.where(F.arrays_overlap(F.transform(words, tx.index_token), F.array(*map(F.lit, sorted(keys)))))
    return found.orderBy(F.col("confidence").desc(), "id").limit(k) if k else found


# -- conflicts -----------------------------------------------------------------------------------------------------


def conflict_keys(facts: DataFrame, synonyms: dict | None = None) -> DataFrame:
    return facts.withColumns({"material_key": entity_key(F.col("material"), synonyms), "property_key": entity_key(F.col("property"), synonyms), "direction": tx.direction(F.col("effect_direction"))})


def conflict_groups(facts: DataFrame, synonyms: dict | None = None) -> DataFrame:
    """material_key, property_key, ups, downs: the keys with facts in both directions. Partial sums, no pairs."""
    keyed = conflict_keys(facts, synonyms)
    counts = keyed.groupBy("material_key", "property_key").agg(F.count_if(F.col("direction") == "increase").alias("ups"), F.count_if(F.col("direction") == "decrease").alias("downs"))
    return counts.where("ups > 0 and downs > 0")


def mark_conflicts(facts: DataFrame, synonyms: dict | None = None) -> DataFrame:
    """facts with status: conflicting where the same material and property have the opposite direction too, else approved. Group-level, so its cost does not grow with pairs."""
    keyed = conflict_keys(facts, synonyms)
    groups = conflict_groups(facts, synonyms).select("material_key", "property_key", F.lit(True).alias("both"))
    status = F.when(F.col("both") & F.col("direction").isin("increase", "decrease"), "conflicting").otherwise("approved")
    return keyed.join(groups, ["material_key", "property_key"], "left").withColumn("status", status).select(*facts.columns, "status")


def conflict_links(facts: DataFrame, synonyms: dict | None = None) -> DataFrame:
    """id, conflicts_with: each fact's opposites, by id. For a selection of facts: the lists hold every pair."""
    keyed = conflict_keys(facts, synonyms).where("direction in ('increase', 'decrease')").select("id", "material_key", "property_key", "direction")
    other = keyed.select(F.col("id").alias("other"), "material_key", "property_key", F.when(F.col("direction") == "increase", "decrease").otherwise("increase").alias("direction"))
    return keyed.join(other, ["material_key", "property_key", "direction"]).groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("conflicts_with"))


def _opposites(keyed: DataFrame) -> DataFrame:
    """material_key, property_key, direction, opposites, first_opposite of each class that has any, written: a short table. Facts are dealt by id once, and counted there."""
    each = keyed.where("direction in ('increase', 'decrease')").select("id", "material_key", "property_key", "direction").repartition("id").distinct()
    of = each.groupBy("material_key", "property_key", "direction").agg(F.count("id").alias("opposites"), F.min("id").alias("first_opposite"))
    return written(of.where("opposites > 0").withColumn("direction", F.when(F.col("direction") == "increase", "decrease").otherwise("increase")))


def conflict_members(facts: DataFrame, synonyms: dict | None = None) -> DataFrame:
    """id, material_key, property_key, direction, opposites, first_opposite: each fact that has opposites, with its class (the two keys and the direction), their number and the least id of them.

    All facts of one class have the same opposites, the class of the other direction; so this says as much as the lists of `conflict_links`, by group counts and without pairs.
    """
    keyed = conflict_keys(facts, synonyms)
    return keyed.join(_opposites(keyed), ["material_key", "property_key", "direction"]).select("id", "material_key", "property_key", "direction", "opposites", "first_opposite")


def conflict_counts(facts: DataFrame, synonyms: dict | None = None) -> DataFrame:
    """id, links: of every fact, each id once, the number of its opposites, 0 without any; of several facts with one id the most."""
    keyed = conflict_keys(facts, synonyms)
    of = _opposites(keyed).select("material_key", "property_key", "direction", "opposites")
    return keyed.join(of, ["material_key", "property_key", "direction"], "left").groupBy("id").agg(F.max(F.coalesce("opposites", F.lit(0)).cast("long")).alias("links"))


def contradictions(facts: DataFrame, tolerance: float = 5.0, synonyms: dict | None = None, block: int = 8192) -> DataFrame:
    """material_key, property_key, labs: opposite effects under comparable conditions, once for each pair of laboratories.

    Comparable: the same process (an empty one goes with any) and temperatures within the tolerance (an unknown one goes with any).
    Facts are first reduced to a row for each (key, process, direction, band of temperatures, lab), with its lowest and highest temperature. A key's laboratories are dealt to blocks of about `block` laboratories,
    of eight times as many rows at most, and every two blocks meet in a cell of their own (`opposed`): a pair belongs to one cell, which makes it once, so no pairs are shuffled, and a key of many rows is work for many tasks.
    """
    keyed = conflict_keys(facts, synonyms).where("direction in ('increase', 'decrease') and material_key is not null and property_key is not null")
    t, key = F.col("temperature_c").cast("double"), ["material_key", "property_key"]
    scaled = t / tolerance
    band = F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)  # beyond, quotients are whole; null: unknown; nan: comparable with unknown ones only
    process, lab = F.coalesce(tx.canonical(F.col("process")), F.lit("")), F.coalesce("lab", F.lit(""))
    named = keyed.select(*key, (F.col("direction") == "increase").alias("up"), process.alias("process"), band.alias("band"), lab.alias("lab"), t.alias("t"))
    points = written(named.groupBy(*key, "up", "process", "band", "lab").agg(F.min("t").alias("lo"), F.max("t").alias("hi")))
    # A text may name different pairs only where a laboratory's name holds what joins them.
    groups = points.groupBy(*key).agg(F.ceil(F.greatest(F.approx_count_distinct("lab") / block, F.count("*") / (8 * block))).cast("int").alias("blocks"), F.max(F.contains("lab", F.lit(", "))).alias("joined"), F.count("*").alias("n"))
    special = written(groups.withColumn("moved", F.col("n") * F.col("blocks")).drop("n"))
    moved, any_joined = special.agg(F.coalesce(F.sum("moved"), F.lit(0)), F.coalesce(F.max("joined"), F.lit(False))).head()

    def paired(points: DataFrame) -> DataFrame:
        met = points.withColumn("block", F.pmod(F.xxhash64("lab"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")}).withColumn("cell", F.xxhash64(*key, "i", "j"))
        n = min(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")), moved // block + 1)
        cells = met.select(*opposed.POINTS).repartition(n, "cell").sortWithinPartitions("cell")
        found = cells.mapInArrow(opposed.pairs(tolerance, block), opposed.FOUND).select(*key, "lab", F.explode("others").alias("other"))
        return found.select(*key, F.when(F.col("lab") == F.col("other"), F.col("lab")).otherwise(F.concat(F.least("lab", "other"), F.lit(", "), F.greatest("lab", "other"))).alias("labs"))

    # Keys of one block, which most are, need not be looked up; the others are few beside the rows.
    large = special.where("blocks > 1").select(*key, "blocks")
    points = points.join(F.broadcast(large), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    if not any_joined:
        return paired(points)
    joined = special.where("joined").select(*key)
    return paired(points.join(joined, key, "left_anti")).unionByName(paired(points.join(joined, key, "left_semi")).distinct())


def phrase(facts: DataFrame) -> DataFrame:
    """id, phrase of facts with material and property: the direction with its value, else the result."""
    col = lambda c, kind: F.col(c) if c in facts.columns else F.lit(None).cast(kind)
    number = lambda v, u: F.concat(tx.general_number(v), F.coalesce(F.concat(F.lit(" "), F.nullif(u, F.lit(""))), F.lit("")))
    effect, result = col("effect_value", "double"), col("result_value", "double")
    way = F.when(F.col("effect_direction").isin("increase", "decrease", "neutral"), F.concat_ws(" на ", tx.direction_label(F.col("effect_direction")), F.when(effect.isNotNull(), number(effect, col("effect_unit", "string")))))
    said = F.coalesce(way, F.when(result.isNotNull(), number(result, col("result_unit", "string"))))
    named = facts.where(~tx.is_junk(F.col("material")) & ~tx.is_junk(F.col("property")))
    return named.select("id", F.concat_ws(": ", F.concat_ws(", ", "material", "property"), said).alias("phrase"))
