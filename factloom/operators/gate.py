"""The gate between extracted candidates and facts: every check is mechanical, and names what it did not find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..domain import Domain
from ..functions import text as tx
from ..functions.quantity import Quantities
from ..shared import written
from .facts import canonical_entity

_ISSUES = "array<struct<code:string,field:string>>"
#: The fields of a payload that number_issues reads.
_NUMBERS = ("temperature_c", "duration_h", "effect_value", "effect_unit", "numeric_parameters")


def _issue(code: str, field: str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))


def _label_unit(label: Column) -> Column:
    """The unit in a label: behind its last comma; without one from a degree or per-cent sign on."""
    return F.when(F.contains(label, F.lit(",")), F.trim(F.substring_index(label, ",", -1))).otherwise(F.trim(F.regexp_extract(label, r"[°%].*$", 0)))


def values_with_units(header: Column, row: Column) -> Column:
    """"value unit" lines of a table row whose cells stand apart from their units.

    The unit is in the column's head, in the row's first cell (heads then name what is compared), or in a column of its own.
    Only rows whose number of cells goes with the head's are read.
    """
    cut = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: tx.strip(x))
    heads, cells = cut(header), cut(row)
    number = lambda c: c.rlike(r"\p{Nd}")
    first = _label_unit(F.get(cells, F.lit(0)))
    rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    with_unit = lambda list_, unit: F.transform(F.filter(list_, number), lambda c: F.concat(c, F.lit(" "), unit))
    longer = F.size(cells) == F.size(heads) + 1
    body = F.when(longer, rest).otherwise(cells)
    labelled = F.lower(F.get(heads, F.lit(0))).rlike("показател|наименован|параметр|характеристик")
    body_unit = _label_unit(F.get(body, F.lit(0)))
    unit_at = F.get(F.filter(F.transform(heads, lambda h, i: F.when(F.lower(h).rlike("единиц|unit"), i)), lambda i: i.isNotNull()), F.lit(0))
    own_unit = F.get(body, unit_at)
    apart = F.transform(F.filter(F.transform(body, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: (x["i"] != unit_at) & number(x["c"])), lambda x: F.concat(x["c"], F.lit(" "), own_unit))
    by_head = F.transform(F.filter(F.arrays_zip(heads.alias("h"), body.alias("c")), lambda x: (_label_unit(x["h"]) != "") & number(x["c"])), lambda x: F.concat(x["c"], F.lit(" "), _label_unit(x["h"])))
    lines = (
        F.when(F.size(heads) < 2, F.array().cast("array<string>"))
        .when(longer & (first != ""), with_unit(rest, first))
        .when(F.size(body) != F.size(heads), F.array().cast("array<string>"))
        .when(labelled & (body_unit != ""), with_unit(F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0))), body_unit))
        .when(unit_at.isNotNull() & (F.coalesce(own_unit, F.lit("")) != ""), apart)
        .otherwise(by_head)
    )
    return F.array_join(lines, "\n")


def field_issues(payload: Column) -> Column:
    """Missing material or property."""
    return F.array_compact(F.array(*[F.when(tx.is_junk(payload[f]), _issue("field_missing", f)) for f in ("material", "property")]))


def judged(candidates: DataFrame, fragments: DataFrame, domain: Domain | None = None) -> DataFrame:
    """candidates (id, payload, source) with quote_validated, number_issues, review_issues, status and confidence.

    fragments: fragment_id, text, header (the head of its table, if it is a row of one). Numbers are looked for in the head, the text and the
    row's values with their units; the quotation in the text alone.
    """
    rows = candidates.withColumn("fragment_id", F.col("source.fragment_id")).join(fragments.select("fragment_id", F.col("text").alias("_text"), F.col("header").alias("_header")), "fragment_id", "left")
    # What the checks read. Numbers are text, which tells -0.0 from 0.0 as number_in_text does, so equal statements are grouped by strings alone.
    said = F.to_json(F.struct(*[F.col(f"payload.{f}").alias(f) for f in _NUMBERS]))
    stated = [F.col("_text"), F.col("_header"), F.col("source").isNotNull().alias("_sourced"), F.col("source.quote").alias("_quote"), said.alias("_said")]
    # Written, because it is read twice, with other columns each time: Spark would join it twice.
    rows = written(rows.withColumn("_key", F.sha2(F.to_json(F.struct(*stated)), 256)))
    kind = T.StructType([f for f in candidates.schema["payload"].dataType.fields if f.name in _NUMBERS])
    checked = _checked(rows.select("_key", *stated).distinct().withColumn("_said", F.from_json("_said", kind)), Quantities(domain))
    rows = rows.join(checked, "_key").withColumn("_fields", field_issues(F.col("payload")))
    origin = F.when(F.col("source").isNull(), F.array(_issue("source_missing", "source"))).when(~F.coalesce("quote_validated", F.lit(False)), F.array(_issue("quote_unconfirmed", "quote"))).otherwise(F.array().cast(_ISSUES))
    issues = F.concat("_fields", origin, "number_issues")
    passed = F.coalesce("quote_validated", F.lit(False)).cast("int") + (F.size("number_issues") == 0).cast("int") + (F.size("_fields") == 0).cast("int")
    rows = rows.withColumn("review_issues", issues).withColumn("status", F.when(F.size("review_issues") == 0, "approved").otherwise("pending_review")).withColumn("confidence", F.round(passed / 3, 3))
    return rows.select(*[c for c in candidates.columns if c not in ("status", "confidence")], "quote_validated", "number_issues", "review_issues", "status", "confidence")


def _checked(stated: DataFrame, q: Quantities) -> DataFrame:
    """_key, quote_validated and number_issues of what candidates state (_text, _header, _sourced, _quote and _said, its numbers), each once however many candidates state it."""
    paired = values_with_units(F.col("_header"), F.col("_text"))
    context = F.array_join(F.filter(F.array("_header", "_text", paired), lambda p: F.coalesce(p, F.lit("")) != ""), "\n")
    rows = stated.withColumn("_context", F.when(context != "", context).otherwise(F.coalesce("_quote", F.lit("")))).withColumn("_hits", q.hits(F.col("_context")))
    some_text = F.coalesce("_text", F.lit("")) != ""
    quote = F.when(F.col("_sourced") & some_text, tx.quote_in_source(F.col("_quote"), F.col("_text")))
    numbers = F.when(F.col("_sourced"), q.number_issues(F.col("_said"), F.col("_context"), F.col("_hits"))).otherwise(F.array().cast(_ISSUES))
    return rows.select("_key", quote.alias("quote_validated"), numbers.alias("number_issues"))


def facts_of(approved: DataFrame, synonyms: dict | None = None) -> DataFrame:
    """Approved candidates as facts. What was not extracted is empty (equipment: null); a missing experiment gets an id from the candidate's."""
    p = lambda f: F.col(f"payload.{f}")
    name = lambda f: tx.clean_extracted(canonical_entity(tx.clean_extracted(p(f)), synonyms))
    way = tx.direction(p("effect_direction"))
    has = set(approved.schema["payload"].dataType.fieldNames())
    clean = lambda f: (tx.clean_extracted(p(f)) if f in has else F.lit("")).alias(f)
    raw = lambda f, kind: (p(f) if f in has else F.lit(None)).cast(kind).alias(f)
    experiment = F.coalesce(F.nullif(p("experiment_id"), F.lit("")), F.concat(F.lit("exp-"), F.substring(F.sha2("id", 256), 1, 8))) if "experiment_id" in has else F.concat(F.lit("exp-"), F.substring(F.sha2("id", 256), 1, 8))
    return approved.where("status = 'approved' and source is not null").select(
        F.concat(F.lit("claim-"), F.regexp_replace("id", "candidate-", "")).alias("id"),
        F.col("id").alias("candidate_id"),
        name("material").alias("material"),
        F.concat(F.lit("material-"), tx.slug(name("material"))).alias("material_id"),
        experiment.alias("experiment_id"),
        clean("sample"), clean("process"), raw("temperature_c", "double"), raw("duration_h", "double"),
        name("property").alias("property"),
        F.when(way == "unknown", "").otherwise(way).alias("effect_direction"),
        raw("effect_value", "double"), raw("effect_unit", "string"), raw("result_value", "double"), raw("result_unit", "string"), clean("lab"), clean("team"),
        (F.nullif(tx.clean_extracted(p("equipment")), F.lit("")) if "equipment" in has else F.lit(None).cast("string")).alias("equipment"),
        "confidence", "source",
    )


def with_headers(fragments: DataFrame) -> DataFrame:
    """fragments (fragment_id, document_id, table, row, text) with header: the first row of the same table; null outside tables and for the head itself."""
    heads = fragments.where("table is not null").groupBy("document_id", "table").agg(F.min_by("text", F.struct("row", "fragment_id")).alias("header"), F.min("row").alias("_first"))
    joined = fragments.join(heads, ["document_id", "table"], "left")
    return joined.withColumn("header", F.when(F.col("row") > F.col("_first"), F.col("header"))).drop("_first")
