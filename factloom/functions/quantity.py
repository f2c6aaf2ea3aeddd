"""Quantities in text: finding numbers with units, converting them, and checking claimed numbers against a source. Column functions only.

A hit is struct<value, unit, kind, normalized_value, normalized_unit>.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domain import Domain
from .text import general_number

# -- fixed values: the grammar of numbers and of one-letter units ---------------------------------------------------

_DIGITS = "(?:\\d{1,3}(?:[   ]\\d{3})+|\\d+)(?:[.,]\\d+)?"
_SIGN = r"[+\-−–]?"
#: No letter, digit, sign or point before a number; no letter or digit behind a unit.
_BOUND = r"(?<![\p{L}\p{N}_.,+\-−–—])"
_TAIL = r"(?![0-9A-Za-zА-Яа-яЁё])"
_DASH = r"\s*(?:\.{2,3}|…|[\-−–—])\s*"
#: One-letter units tell by case: capital C is a temperature, small s a time.
_LETTERS = r"%|[°о]\s*[CcСс]|h|ч|m|м|(?-iu:[CС])|(?-iu:[sс])|(?-iu:[VВ])|(?-iu:[KК])"
_PH = r"(?iu)(?<![A-Za-zА-Яа-яЁё])[pр][hн]\s*[=:]?\s*([+\-−]?\d+(?:[.,]\d+)?)(?:\s*(?:\.{2,3}|…|[\-−–—])\s*(\d+(?:[.,]\d+)?))?"

# ------------------------------------------------------------------------------------------------------------------

HIT = "struct<value: double, unit: string, kind: string, normalized_value: double, normalized_unit: string>"


class Quantities:
    """The operators for one set of dictionaries."""

    def __init__(self, domain: Domain | None = None):
        self.domain = domain or Domain()
        self.units = {alias.lower(): unit for unit in self.domain.units for alias in unit[5]}
        words = sorted({a for u in self.domain.units for a in u[5] if len(a) > 1}, key=lambda a: (-len(a), a))
        unit = "|".join([*(re.sub(r"([^\w])", r"\\\1", a) for a in words), _LETTERS])
        self.range = rf"(?iu){_BOUND}({_SIGN}{_DIGITS}){_DASH}({_SIGN}{_DIGITS})\s*({unit}){_TAIL}"
        self.single = rf"(?iu){_BOUND}({_SIGN}{_DIGITS})\s*({unit}){_TAIL}"

    def key(self, unit: Column) -> Column:
        """How units are looked up."""
        return F.lower(F.translate(F.regexp_replace(F.coalesce(unit, F.lit("")), r"(?U)\s+", ""), "³²μ", "32u"))

    @cached_property
    def _units(self) -> Column:
        """The units as one map, made once: it is used in many places of an expression."""
        pairs = []
        for alias, (kind, name, dimension, factor, offset, _) in self.units.items():
            own = self.domain.quantities.get(kind)
            same = own is not None and own[0] == dimension
            fields = {"kind": kind, "unit": name, "dimension": dimension, "factor": factor, "offset": offset, "own_unit": own[1] if same else None, "own_factor": own[2] if same else None}
            kinds = {"factor": "double", "offset": "double", "own_factor": "double"}
            pairs += [F.lit(alias), F.struct(*[F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in fields.items()])]
        return F.create_map(*pairs)

    @cached_property
    def _targets(self) -> Column:
        pairs = []
        for name, (dimension, unit, factor) in self.domain.quantities.items():
            pairs += [F.lit(name), F.struct(F.lit(dimension).alias("dimension"), F.lit(unit).alias("unit"), F.lit(factor).alias("factor"))]
        return F.create_map(*pairs)

    def spec(self, unit: Column) -> Column:
        """struct<kind, unit, dimension, factor, offset, own_unit, own_factor> of a unit, or null; own: of the quantity that is named like its kind."""
        return F.try_element_at(self._units, self.key(unit))

    def target(self, quantity: Column) -> Column:
        """struct<dimension, unit, factor> of a quantity, or null."""
        return F.try_element_at(self._targets, F.coalesce(quantity, F.lit("")))

    def convert(self, value: Column, unit: Column, quantity: Column, spec: Column | None = None, target: Column | None = None) -> Column:
        """struct<value, unit> of a value in the quantity's unit; null where the unit is unknown or of another dimension.

        Without a quantity (or an unknown one) the value is as it is; without a unit it is in the quantity's.
        spec, target: those of the unit and the quantity, where they are columns already: a plan then holds the dictionaries once.
        """
        spec, target = self.spec(unit) if spec is None else spec, self.target(quantity) if target is None else target
        key = self.key(unit)
        pair = lambda v, u: F.struct(v.cast("double").alias("value"), u.cast("string").alias("unit"))
        as_is = ((quantity == "dimensionless") & (key == "ph")) | ((quantity == "concentration_trace") & (key == "ppm")) | (F.trim(F.coalesce(unit, F.lit(""))) == "")
        affine = (value * spec["factor"] + spec["offset"]) * target["factor"]
        return (
            F.when(target.isNull(), pair(value, F.coalesce(unit, F.lit(""))))
            .when(as_is, pair(value, target["unit"]))
            .when(spec.isNotNull() & (spec["dimension"] == target["dimension"]), pair(affine, target["unit"]))
        )

    def number(self, raw: Column) -> Column:
        return F.replace(F.translate(F.translate(raw, "−–", "--"), "   ", ""), F.lit(","), F.lit(".")).try_cast("double")

    def readings(self, found: Column) -> Column:
        """found: array<struct<raw, unit>> -> hits: for each number one, or for a scale with a shifted zero two (a point on it, and a difference).

        Each step binds its results as a field, so later steps name them instead of computing them again.
        """
        bare = lambda u: F.regexp_replace(u, " ", "")
        letter = lambda u: F.when(u.isin("С", "C"), "°C").when(u.isin("с", "s"), "сек").otherwise(u)
        one = F.transform(found, lambda f: F.struct(self.number(f["raw"]).alias("value"), bare(f["unit"]).alias("unit")))
        two = F.transform(one, lambda f: F.struct(f["value"].alias("value"), letter(f["unit"]).alias("unit")))
        three = F.transform(two, lambda f: F.struct(f["value"].alias("value"), f["unit"].alias("unit"), self.spec(f["unit"]).alias("spec")))

        def close(f: Column) -> Column:
            spec, known = f["spec"], f["spec"]["own_unit"].isNotNull()
            normal = F.when(known, (f["value"] * spec["factor"] + spec["offset"]) * spec["own_factor"]).otherwise(f["value"])
            return F.struct(f["value"].alias("value"), f["unit"].alias("unit"), F.when(known, spec["kind"]).otherwise("unknown").alias("kind"), normal.alias("normalized_value"), F.when(known, spec["own_unit"]).otherwise(f["unit"]).alias("normalized_unit"), F.coalesce(spec["offset"], F.lit(0.0)).alias("offset"))

        four = F.transform(three, close)
        reading = lambda h, n: F.struct(*[h[k].alias(k) for k in ("value", "unit", "kind")], n.alias("normalized_value"), h["normalized_unit"].alias("normalized_unit"))
        return F.flatten(F.transform(four, lambda h: F.when(h["offset"] != 0, F.array(reading(h, h["normalized_value"]), reading(h, h["normalized_value"] - h["offset"]))).otherwise(F.array(reading(h, h["normalized_value"])))))

    def hits(self, text: Column) -> Column:
        """All quantities of a text: ranges (both ends), then single numbers outside them, then pH."""
        text = F.coalesce(text, F.lit(""))
        group = lambda source, pattern, k: F.regexp_extract_all(source, F.lit(pattern), F.lit(k))
        pair = lambda raw, unit: F.struct(raw.alias("raw"), unit.alias("unit"))
        ends = F.arrays_zip(group(text, self.range, 1).alias("a"), group(text, self.range, 2).alias("b"), group(text, self.range, 3).alias("u"))
        ranges = F.flatten(F.transform(ends, lambda e: F.array(pair(e["a"], e["u"]), pair(e["b"], e["u"]))))
        rest = F.regexp_replace(text, self.range, " ¤ ")
        singles = F.transform(F.arrays_zip(group(rest, self.single, 1).alias("a"), group(rest, self.single, 2).alias("u")), lambda e: pair(e["a"], e["u"]))
        acid = lambda v: F.struct(v.alias("value"), F.lit("pH").alias("unit"), F.lit("dimensionless").alias("kind"), v.alias("normalized_value"), F.lit("pH").alias("normalized_unit"))
        both = F.arrays_zip(group(text, _PH, 1).alias("a"), group(text, _PH, 2).alias("b"))
        ph = F.flatten(F.transform(both, lambda e: F.filter(F.array(acid(self.number(e["a"])), acid(self.number(e["b"]))), lambda h: h["value"].isNotNull())))
        return F.concat(self.readings(F.concat(ranges, singles)), ph)

    def rule(self, name: Column) -> Column:
        """struct<name, quantity, least, most> of the first range whose name is in the parameter's, or null."""
        rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("quantity"), F.lit(float(a)).alias("least"), F.lit(float(b)).alias("most")) for n, q, a, b in self.domain.ranges])
        return F.get(F.filter(rules, lambda r: F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lower(r["name"]))), F.lit(0))

    def seen(self, value: Column, unit: Column, quantity: Column, hits: Column, text: Column, tolerance: float = 0.01) -> Column:
        """Whether the source states a value: in its unit's dimension; without a known unit in the rule's quantity; else as a bare number."""
        spec = self.spec(unit)

        def in_dimension(h: Column) -> Column:
            other = self.spec(h["unit"])
            return F.coalesce((other["dimension"] == spec["dimension"]) & (F.abs(h["value"] * other["factor"] - value * spec["factor"]) <= tolerance), F.lit(False))

        wanted = self.convert(value, unit, quantity)
        in_quantity = lambda h: F.coalesce(F.abs(self.convert(h["value"], h["unit"], quantity)["value"] - wanted["value"]) <= tolerance, F.lit(False))
        bare = F.exists(hits, lambda h: F.abs(h["value"] - value) <= tolerance) | number_in_text(value, text)
        return F.when(spec.isNotNull(), F.exists(hits, in_dimension)).when(quantity.isNotNull(), wanted.isNotNull() & F.exists(hits, in_quantity)).otherwise(bare)

    def number_issues(self, payload: Column, text: Column, hits: Column) -> Column:
        """array<struct<code, field>> of a candidate's numbers that its source does not confirm or that are implausible."""
        issue = lambda code, field: F.struct(F.lit(code).alias("code"), field.cast("string").alias("field"))
        some = F.coalesce(text, F.lit("")) != ""
        none = F.lit(None).cast("string")

        def stated(field: str, kind: str, tolerance: float) -> Column:
            near = F.exists(hits, lambda h: (h["kind"] == kind) & (F.abs(h["normalized_value"] - payload[field]) <= tolerance))
            return F.when(payload[field].isNotNull() & ~near & some, issue("number_unconfirmed", F.lit(field)))

        effect_unit = F.when(self.spec(payload["effect_unit"]).isNotNull(), payload["effect_unit"]).when(F.coalesce(payload["effect_unit"], F.lit("")) == "", F.lit("%"))
        effect = F.when(payload["effect_value"].isNotNull() & some & ~self.seen(payload["effect_value"], effect_unit, none, hits, text, 0.1), issue("number_unconfirmed", F.lit("effect_value")))

        def of_parameter(p: Column) -> Column:
            rule = self.rule(p["name"])
            values = F.array_compact(F.array(p["value"], p["value_min"], p["value_max"]))
            in_unit = F.transform(values, lambda v: self.convert(v, p["unit"], rule["quantity"])["value"])
            unseen = F.when(some & ~F.forall(values, lambda v: self.seen(v, p["unit"], rule["quantity"], hits, text)), issue("number_unconfirmed", p["name"]))
            mismatch = F.when(rule.isNotNull() & F.exists(in_unit, lambda v: v.isNull()), issue("unit_mismatch", p["name"]))
            off = F.when(rule.isNotNull() & mismatch.isNull() & F.exists(in_unit, lambda v: ~v.between(rule["least"], rule["most"])), issue("number_implausible", p["name"]))
            return F.when(F.size(values) > 0, F.array_compact(F.array(unseen, mismatch, off))).otherwise(F.array().cast("array<struct<code:string,field:string>>"))

        fields = F.array_compact(F.array(stated("temperature_c", "temperature", 1.0), stated("duration_h", "duration", 0.1), effect))
        parameters = F.coalesce(F.flatten(F.transform(payload["numeric_parameters"], of_parameter)), F.array().cast("array<struct<code:string,field:string>>"))
        return F.concat(fields, parameters)

    def in_range(self, item: Column, condition_min: Column, condition_max: Column, condition_unit: Column) -> Column:
        """Whether a parameter (struct<value, value_min, value_max, unit>) can meet a condition; what can't be compared passes."""
        kind = self.spec(condition_unit)["kind"]
        to = lambda v, u: F.coalesce(self.convert(v, u, kind)["value"], v)
        low, high = to(F.coalesce(item["value_min"], item["value"]), item["unit"]), to(F.coalesce(item["value_max"], item["value"]), item["unit"])
        least, most = to(condition_min, condition_unit), to(condition_max, condition_unit)
        return ~(F.coalesce(high < least, F.lit(False)) | F.coalesce(low > most, F.lit(False)))


def number_in_text(value: Column, text: Column) -> Column:
    """Whether the text holds the number as %g writes it, with point or comma, and no more digits around it."""
    plain = general_number(value)
    escaped = F.replace(F.replace(plain, F.lit("."), F.lit("[.,]")), F.lit("+"), F.lit("\\+"))
    return F.coalesce(F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"(?<![\p{L}\p{N}_.,\-])"), escaped, F.lit(r"(?!\d|[.,]\d)"))), F.lit(False))
